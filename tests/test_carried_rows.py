"""Read rows carried across blocks, against one pass over the blocks of a contig in order."""

import random
from collections import defaultdict
from pathlib import Path

import pytest

from strandlake.operators import read_matrix
from strandlake.plans import extra_queries
from strandlake.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
ROWS = "ref_name string, block long, qname string, row int"


def one_pass(rows, size=100):
    """(ref, block, qname) -> row: each block's rows are turned so that reads of the block before keep theirs; the rest fill what is left, in order."""
    blocks = defaultdict(dict)
    for ref, block, name, row in rows:
        blocks[ref, block][name] = row
    turn, done = {}, {}
    for ref, block in sorted(blocks):
        here, before = blocks[ref, block], blocks.get((ref, block - 1), {})
        old = turn.get(ref, list(range(size)))
        crossing = {before[n]: here[n] for n in here.keys() & before.keys()}
        spare = iter(sorted(set(range(size)) - set(crossing.values())))
        link = [crossing[k] if k in crossing else None for k in range(size)]
        new = old
        if crossing:
            link = [k if k is not None else next(spare) for k in link]
            new = [link[k] for k in old]
        turn[ref] = new
        for name, row in here.items():
            done[ref, block, name] = new.index(row)
    return done


def collected(df):
    return {(r.ref_name, r.block, r.qname): r.row for r in df.collect()}


@pytest.mark.parametrize(("stretch", "reads", "size"), [(1, 100, 100), (3, 6, 6), (64, 100, 100)])
def test_carried(spark, stretch, reads, size):
    rng = random.Random(stretch)
    spans = []
    for k in range(160):
        start = rng.randrange(2000) + (3000 if k % 5 == 0 else 0)
        spans.append((rng.choice("ab"), f"r{k:03d}", start, start + rng.choice((20, 90, 300, 900))))
    placed = read_matrix.assign_rows(spark.createDataFrame(spans, "ref_name string, qname string, start long, end long"), block=100, max_reads=reads).cache()
    rows = [(r.ref_name, r.block, r.qname, r.row) for r in placed.collect()]
    got = collected(read_matrix.carry_rows(placed, size, stretch))
    assert got == one_pass(rows, size) and len(got) == len(rows)
    by_block, by_read = defaultdict(list), defaultdict(dict)
    for (ref, block, name), row in got.items():
        by_read[ref, name][block] = row
        by_block[ref, block].append((row, name))
    # One row over all blocks that follow each other, and in a block the same reads share rows as before.
    assert all(at.get(block + 1, row) == row for at in by_read.values() for block, row in at.items())
    old = {(ref, block, name): row for ref, block, name, row in rows}
    for (ref, block), held in by_block.items():
        assert len({(row, old[ref, block, name]) for row, name in held}) == len({row for row, _ in held})


def test_empty_and_single(spark):
    assert read_matrix.carry_rows(spark.createDataFrame([], ROWS)).count() == 0
    lone = [("a", 7, "x", 3), ("a", 9, "x", 0)]
    assert collected(read_matrix.carry_rows(spark.createDataFrame(lone, ROWS))) == {("a", 7, "x"): 3, ("a", 9, "x"): 0}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")
def test_query(spark):
    placed = read_matrix.assign_rows(extra_queries.order_reads(spark, DATA), block=50)
    rows = [(r.ref_name, r.block, r.qname, r.row) for r in placed.collect()]
    assert collected(QUERIES["jn10_carried_rows_win6"](spark, DATA)) == one_pass(rows)


def test_many_contigs_stream_through_a_task(spark):
    """Contigs are no groups of their own: Python is called for a partition, and what is passed on of a stretch is as long as the rows it uses."""
    rows = spark.createDataFrame([(f"c{k}", block, f"r{n}", (n + block) % 3) for k in range(40) for block in (62, 63, 64, 65, 200) for n in range(3)], ROWS)
    got = read_matrix.carry_rows(rows)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert collected(got) == one_pass([tuple(r) for r in rows.collect()])
