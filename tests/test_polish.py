"""Polishing of drafts with planted errors."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import reads
from strandlake.plans import polish


def planted(rng, seq, errors):
    """``seq`` with ``errors`` substitutions, insertions and deletions."""
    out = list(seq)
    for _ in range(errors):
        at, kind = rng.randrange(len(out)), rng.choice("sid")
        if kind == "s":
            out[at] = rng.choice([b for b in "ACGT" if b != out[at]])
        elif kind == "i":
            out.insert(at, rng.choice("ACGT"))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def test_planted_errors_go(spark):
    rng = random.Random(3)
    truth = {f"m{k}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(80, 300))) for k in range(5)}
    edges = [("none", "acgt"), ("empty", ""), ("null", None), ("same", "ACGTAC"), (None, "AC")]
    drafts = spark.createDataFrame([(n, planted(rng, s, 8)) for n, s in truth.items()] + edges, "name string, seq string")
    rows = [(n, f"r{k}", planted(rng, s, len(s) // 40)) for n, s in truth.items() for k in range(15)]
    rows += [("same", "a", "ACGTAC"), ("same", "b", None), ("empty", "c", "ACG"), ("other", "d", "A"), ("same", "e", "")]
    got = {r.name: r for r in polish.polish(drafts, spark.createDataFrame(rows, "name string, read string, seq string")).collect()}
    assert {n: got[n].seq for n in truth} == truth
    assert all(r.settled for r in got.values()) and all(1 <= got[n].rounds <= 4 for n in truth)
    assert {n: (got[n].seq, got[n].rounds) for n, _ in edges} == {"none": ("ACGT", 0), "empty": ("", 0), "null": (None, 0), "same": ("ACGTAC", 0), None: ("AC", 0)}


def test_unsettled_is_told(spark):
    drafts = spark.createDataFrame([("m", "ACGTACGTTT")], "name string, seq string")
    subreads = spark.createDataFrame([("m", f"r{k}", "ACGGACGTT") for k in range(3)], "name string, read string, seq string")
    one = polish.polish(drafts, subreads, rounds=1).first()
    assert (one.seq, one.rounds, one.settled) == ("ACGGACGTT", 1, False)
    assert polish.polish(drafts.limit(0), subreads).count() == 0
    with pytest.raises(ValueError):
        polish.polish(drafts, subreads, rounds=0)


def test_chunks_see_each_base_once(spark):
    rng = random.Random(5)
    truth = "".join(rng.choice("ACGT") for _ in range(900))
    drafts = spark.createDataFrame([("m", planted(rng, truth, 9))], "name string, seq string")
    subreads = spark.createDataFrame([("m", f"r{k}", planted(rng, truth, 9)) for k in range(4)], "name string, read string, seq string")
    rows = polish.aligned_reads(drafts, subreads, chunk=150, pad=60)
    assert rows.count() > 4 * 4
    seen = reads.observations(rows).where("symbol <> '*'")
    assert seen.groupBy("qname", "major", "minor").count().where("count > 1").count() == 0
    lengths = {r.pair: r.n for r in subreads.select(F.to_json(F.struct("name", "read")).alias("pair"), F.length("seq").alias("n")).collect()}
    # All bases but those before the first aligned one are seen.
    assert all(lengths[r.qname] - 2 <= r["count"] <= lengths[r.qname] for r in seen.groupBy("qname").count().collect())
