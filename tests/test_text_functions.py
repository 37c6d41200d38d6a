"""Record names and CIGARs taken apart by their text: same results as by patterns, and no pattern for each field."""

import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequences as S

BY_PATTERN = "^(.*)" + "_([^_]*)" * 9 + "$"


def test_record_names_as_by_pattern(spark):
    names = ["q_1_c7_1_9_0_10_fwd_3_7_2", "_c_1_2_3_4_rev_1_2_3", "a_b__c_1_2_3_4__1_2_3", "ä_ö_1_2_3_4_fwd_1_2_3"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").withColumn("p", S.record_name_parse(F.col("name")))
    text = [F.regexp_extract("name", BY_PATTERN, k + 1) for k in range(len(S.RECORD_FIELDS))]
    for r in rows.select("p", F.array(*text).alias("want")).collect():
        assert [str(x) for x in r.p] == r.want
    odd = spark.createDataFrame([(None,), ("c_1_2_3_4_fwd_1_2_3",)], "name string").select(S.record_name_parse(F.col("name"))["ref_name"].alias("r"))
    assert [r.r for r in odd.collect()] == [None, ""]


def by_operations(cigar):
    ops = [(int(n), op) for n, op in __import__("re").findall(r"(\d+)(\D)", cigar)]
    first = next((k for k, (_, op) in enumerate(ops) if op == "="), len(ops))
    on = lambda kinds: sum(n for n, op in ops[:first] if op in kinds)
    return "".join(f"{n}{op}" for n, op in ops[first:]), on(S.ON_READ), on(S.ON_REFERENCE)


def test_trimmed_cigars_as_by_operations(spark):
    cigars = ["3S10=2D", "5=", "4M3I", "", "*", "2H3S1X4D12=3X1=2S", "1I2D3=4D5="]
    rows = spark.createDataFrame([(c,) for c in cigars], "cigar string").select("cigar", S.trim_cigar_start(F.col("cigar")).alias("t"))
    assert {r.cigar: tuple(r.t) for r in rows.collect()} == {c: by_operations(c) for c in cigars}


@pytest.mark.parametrize("made", [lambda: S.record_name_parse(F.col("c")), lambda: S.trim_cigar_start(F.col("c"))["cigar"]])
def test_no_pattern_for_each_field(spark, made):
    assert "regexp" not in spark.createDataFrame([("x",)], "c string").select(made().alias("x"))._jdf.queryExecution().optimizedPlan().toString()
