"""Schemas of the data model, as DDL. Positions are 0-based, ends exclusive."""

from __future__ import annotations

ALIGNMENT = (
    "qname string, flag int, ref_name string, pos long, mapq int, cigar string, seq string, qual array<int>, tags map<string,string>"
)
INTERVAL = "ref_name string, start long, end long"
VARIANT = (
    "chrom string, pos long, id string, ref string, alt array<string>, qual double, filter array<string>, info map<string,string>, "
    "genotype array<struct<k:string,v:string>>"
)
SEQUENCE = "name string, comment string, seq string, qual string"
COLUMN = "sample_id string, ref_name string, major long, minor long, probs array<double>, depth long"
SUBREAD = "read_id string, subread string, seq string"

#: Codes of one pileup column, reverse strand first in lower case, d and D for deletions.
BASE_CODES = "acgtACGTdD"
#: Class symbols of a haploid consensus, the gap first.
CLASS_SYMBOLS = "*ACGT"
