"""Several queries aligned to one reference at once: as each by itself, and each of equal ones once."""

import random

from strandlake.operators import align


def test_together_as_each_by_itself(monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    for cells in (1, 500, 1 << 20):
        monkeypatch.setattr(align, "CELLS", cells)
        for _ in range(15):
            ref = text(rng.randrange(0, 30))
            queries = [text(rng.randrange(0, 40)) for _ in range(6)] + [ref, ref[3:] + "A", ""]
            assert align.align_all(queries, ref) == [align.align_pair(q, ref, "global")[2] for q in queries]


def test_tables_are_made_once_for_a_molecule(monkeypatch):
    made = []
    tables = align._tables
    monkeypatch.setattr(align, "_tables", lambda queries, *rest: made.append(len(queries)) or tables(queries, *rest))
    align.align_all(["ACGT", "ACG", "ACGG", "ACG", "ACGT"], "ACGT")
    assert made == [2]


def test_molecules_are_spread_over_tasks(spark):
    """Little text takes long to align, so tasks are not merged by their bytes."""
    rows = spark.createDataFrame([(k, "ACGTACGT") for k in range(400)], "k long, seq string")
    assert align.star_consensus(rows, ["k"]).rdd.getNumPartitions() > 1
