"""Merging two haplotypes: calls that cancel out, shared bases, calls that contradict the reference."""

import pytest

from strandlake.operators import variants

SCHEMA = "chrom string, pos long, ref string, alt string, qual double"


def merge(spark, one, two, seq):
    reference = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    return variants.merge_haplotypes(spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA), reference)


def test_cancelled_haplotype(spark):
    # AA -> A and A -> AA next to each other leave the first haplotype as the reference.
    got = merge(spark, [("c", 0, "AA", "A", 50.0), ("c", 2, "T", "AT", 50.0)], [("c", 0, "A", "G", 10.0)], "AATC").collect()
    assert [tuple(r) for r in got] == [("c", 0, "A", ["G"], "0|1", 10.0)]


def test_shared_bases(spark):
    got = merge(spark, [("c", 1, "CGT", "CAT", 10.0)], [("c", 1, "CGT", "CTT", 30.0)], "ACGTA").collect()
    assert [tuple(r) for r in got] == [("c", 2, "G", ["A", "T"], "1|2", 20.0)]


def test_call_against_reference(spark):
    with pytest.raises(Exception, match="reference differs"):
        merge(spark, [("c", 1, "G", "T", 10.0)], [("c", 3, "T", "A", 10.0)], "ACGTA").collect()
