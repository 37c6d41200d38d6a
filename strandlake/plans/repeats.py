"""Variant records of tandem repeats: reads of each haplotype, their polished consensus, its alignment to the reference, and records of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edit_align, poa, tandem, windows
from ..session import cut_lineage
from .pipelines import region_reads
from .polish import polish

REGION = ["ref_name", "start", "end"]
#: Bases on each side of a region that its reads and its consensus keep, so that alignment is not free at its ends.
PADDING = 10


def phased_reads(alignments: DataFrame, regions: DataFrame, phasing: str = "sequence", min_reads: int = 3, padding: int = PADDING) -> DataFrame:
    """ref_name, start, end, from, to, hap, phase_set, qname, seq, length: reads of each region, padded to [from, to), by haplotype.

    ``phasing``: ``tags`` takes the haplotype and phase set of the tags HP and PS and only reads of the region's most frequent phase set;
    ``sequence`` and ``length`` cluster the reads. A region of one cluster has haplotype 0, which stands for both. Regions given twice are one.
    """
    if phasing not in ("tags", "sequence", "length"):
        raise KeyError(f"phasing {phasing} is not one of tags, sequence, length")
    own = regions.select(*REGION).distinct()
    padded = own.select("ref_name", F.greatest(F.col("start") - padding, F.lit(0)).cast("long").alias("start"), (F.col("end") + padding).cast("long").alias("end"), F.struct("start", "end").alias("own"))
    kept = region_reads(alignments, padded, min_reads).withColumnsRenamed({"start": "from", "end": "to"}).select("ref_name", "own.start", "own.end", "from", "to", "qname", "tags", "seq", "n")
    if phasing == "tags":
        tag = lambda t: F.try_element_at("tags", F.lit(t)).try_cast("int")
        told = kept.withColumn("hap", tag("HP")).withColumn("phase_set", F.coalesce(tag("PS"), F.lit(0)).cast("long")).where("hap in (1, 2)")
        told = tandem.dominant(told, REGION, "phase_set")
    else:
        told = poa.sequence_clusters(kept, REGION) if phasing == "sequence" else tandem.two_clusters(kept, REGION, "n")
        two = told.groupBy(*REGION).agg((F.max("cluster") > 1).alias("_two"))
        told = told.join(two, REGION).withColumn("hap", F.when(F.col("_two"), F.col("cluster")).otherwise(0)).withColumn("phase_set", F.lit(0).cast("long"))
    return told.select(*REGION, "from", "to", F.col("hap").cast("int").alias("hap"), "phase_set", "qname", "seq", F.col("n").alias("length"))


def haplotypes(reads: DataFrame, reference: DataFrame, rounds: int = 2) -> DataFrame:
    """ref_name, start, end, from, hap, phase_set, name, seq, ref: polished consensus of each haplotype of ``phased_reads`` and the padded reference slice."""
    keys = [*REGION, "from", "to", "hap", "phase_set"]
    name = F.concat_ws(":", "ref_name", "start", "end", "hap")
    drafts = cut_lineage(poa.molecule_consensus(reads.select(*keys, "seq"), keys).withColumn("name", name))
    if rounds:
        better = polish(drafts.select("name", "seq"), reads.select(name.alias("name"), F.col("qname").alias("read"), "seq"), rounds)
        drafts = drafts.drop("seq").join(better.select("name", "seq"), "name")
    sliced = windows.slices(drafts, windows.windowed(reference), "ref_name", "from", "to", "ref")
    return cut_lineage(sliced.select(*keys, "name", "seq", F.upper("ref").alias("ref")))


def records(haplotypes: DataFrame, reads: DataFrame, style: str = "replace", read_names: bool = False) -> DataFrame:
    """Variant records of ``haplotypes``: ``replace``, one a region with its whole alleles; ``decompose``, one for each event of a haplotype."""
    if style not in ("replace", "decompose"):
        raise KeyError(f"style {style} is not one of replace, decompose")
    pairs = haplotypes.select("name", F.col("seq").alias("query"), "ref")
    placed = edit_align.align_long(pairs, "NW", with_variants=style == "decompose").withColumnRenamed("start", "start_in").join(haplotypes, "name")
    if style == "decompose":
        events = placed.select(*REGION, "hap", "from", F.inline("variants").alias("at", "old", "alt"))
        return tandem.decomposed_records(events.select(*REGION, "hap", (F.col("from") + F.col("at")).alias("pos"), F.col("old").alias("ref"), "alt"), reads)
    inside = tandem.aligned_bounds(F.col("cigar"), F.col("from") + F.col("start_in"), F.col("start"), F.col("end"))
    bounds = placed.withColumn("_b", inside).groupBy("name").agg(F.min(F.col("q_start") + F.col("_b.low")).alias("low"), F.max(F.col("q_start") + F.col("_b.high")).alias("high"))
    joined = haplotypes.join(bounds, "name", "left")
    found = F.when(F.col("low").isNotNull(), F.struct("low", "high"))
    own = F.substr("ref", (F.col("start") - F.col("from") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    alleles = joined.select(*REGION, "hap", "phase_set", tandem.bounded_allele(F.col("seq"), found).alias("allele"), own.alias("ref"))
    return tandem.replacement_records(alleles, reads, read_names)
