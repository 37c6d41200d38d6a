"""Chunks trimmed and stitched as rows of runs, against the rules applied to sets of positions."""

import random

from pyspark.sql import functions as F

from strandlake.operators import consensus

SYMBOLS = "*ACGT"


def chunks_of(rng: random.Random) -> dict[str, list[tuple[int, int]]]:
    """Overlapping chunks of one contig; some have other insertions than their neighbours, some a hole."""
    found, at = {}, 0
    for k in range(12):
        size, own = rng.randrange(3, 30), rng.random() < 0.4
        majors = [m for m in range(at, at + size) if m == at or m == at + size - 1 or rng.random() > 0.04 * own]
        found[f"s{k:03d}"] = sorted([(m, 0) for m in majors] + [(m, i + 1) for m in majors for i in range(m % 11 == 0 or (own and rng.random() < 0.2))])
        at += rng.randrange(0, size + 4)
    return found


def trimmed(chunks: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    kept, reach = [], None
    for name, places in sorted(chunks.items(), key=lambda c: (c[1][0], -len(c[1]), c[0])):
        if reach is None or places[-1] > reach:
            kept.append((name, places))
            reach = places[-1]
    kept.sort(key=lambda c: (c[1][0], c[0]))
    cuts = []
    for (_, one), (_, two) in zip(kept, kept[1:], strict=False):
        a, b = [p for p in one if two[0] <= p <= one[-1]], [p for p in two if two[0] <= p <= one[-1]]
        majors = sorted({m for m, _ in a + b})
        if not a and not b or two[0] > one[-1]:
            cuts.append(None)
        elif a == b:
            cuts.append(a[len(a) // 2])
        else:
            middle = (majors[0] + majors[-1]) // 2
            count = lambda places, m: sum(x == m for x, _ in places)
            even = [m for m in majors if m != middle and count(a, m) == count(b, m)] if len(majors) > 3 else []
            cuts.append((min(even, key=lambda m: (abs(m - middle), -m), default=middle), 0))
    return {name: [p for p in places if (not k or cuts[k - 1] is None or p >= cuts[k - 1]) and (k == len(cuts) or cuts[k] is None or p < cuts[k])] for k, (name, places) in enumerate(kept)}


def columns_of(spark, contigs):
    rows = [(ref, name, m, i, (m * 7 + i + len(ref)) % 9) for ref, chunks in contigs.items() for name, places in chunks.items() for m, i in places]
    frame = spark.createDataFrame(rows, "ref_name string, sample_id string, major long, minor long, depth long")
    return frame.withColumn("probs", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.when((F.col("major") + F.col("minor")) % 5 == k, F.lit(0.9)).otherwise(0.025)))


def test_trimmed_as_by_sets(spark):
    rng = random.Random(3)
    contigs = {f"c{k}": chunks_of(rng) for k in range(25)}
    got = {}
    for r in consensus.trim_chunks(columns_of(spark, contigs)).collect():
        got.setdefault(r.ref_name, {}).setdefault(r.sample_id, []).append((r.major, r.minor))
    want = {ref: {name: places for name, places in trimmed(chunks).items() if places} for ref, chunks in contigs.items()}
    assert {ref: {name: sorted(places) for name, places in chunks.items()} for ref, chunks in got.items()} == want


def test_stitched_as_by_sets(spark):
    rng = random.Random(4)
    contigs = {f"c{k}": chunks_of(rng) for k in range(20)}
    contigs["gap"] = {"s": [(0, 0), (5, 0)]}
    for least in (None, 3):
        want = set()
        for ref, chunks in contigs.items():
            places = sorted(p for kept in trimmed(chunks).values() for p in kept if least is None or (p[0] * 7 + p[1] + len(ref)) % 9 >= least)
            for k, p in enumerate(places):
                if not k or p[0] - places[k - 1][0] > 1:
                    piece = []
                if piece == []:
                    pieces = piece
                piece.append(p)
                if k + 1 == len(places) or places[k + 1][0] - p[0] > 1:
                    seq = "".join(SYMBOLS[(m + i) % 5] for m, i in pieces).replace("*", "")
                    want.add((ref, pieces[0][0], pieces[-1][0], seq or None, len(seq) or None))
        rows = consensus.stitch(columns_of(spark, contigs), least).collect()
        assert {(r.ref_name, r.start, r.stop, r.seq, r.qual and len(r.qual)) for r in rows} == want


def test_no_column_is_shuffled_by_itself(spark):
    """A chunk crosses to its contig as a row of runs, so a column costs less than its position and probabilities take."""
    from strandlake.plans.queries import QUERIES

    for name in ("con3_stitch_chunks", "stm2_trim_chunks"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 1, name


def test_equal_intervals_after_a_gap(spark):
    """Of two equal intervals neither joins the island before the gap (customer 209577 of orders 60 times sf0.1)."""
    from strandlake.operators import intervals

    rows = [(1, s, e) for s, e in [(223, 293), (232, 269), (259, 317), (308, 333), (322, 369), (397, 449), (397, 449)]]
    got = intervals.merge(spark.createDataFrame(rows, "ref_name long, start long, end long"), ["ref_name"]).collect()
    assert sorted((r.start, r.end, r.n) for r in got) == [(223, 369, 5), (397, 449, 2)]


def test_chunks_are_dealt_to_a_set_number_of_tasks(spark):
    """Adaptive execution would merge tasks by shuffled bytes, which for runs are a small part of what a task sorts (it spilled on orders 60 times sf0.1)."""
    from strandlake.plans.queries import QUERIES

    for name in ("con3_stitch_chunks", "stm2_trim_chunks"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism, name


def test_chunks_without_columns_and_of_one_beginning(spark):
    """A chunk without columns is left out; of two that begin together, each reaching further or having more columns, the smaller name comes first."""
    chunks = {"none": [], "b": [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (3, 0)], "a": [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)], "c": [(4, 0), (5, 0)]}
    rows = [("r", name, [(m, i) for m, i in places]) for name, places in chunks.items()]
    samples = consensus.with_runs(spark.createDataFrame(rows, "ref_name string, sample_id string, cells array<struct<major: long, minor: long>>"))
    kept = samples.transform(consensus.trim_samples).withColumn("runs", consensus.clip_runs(F.col("runs"), F.col("start"), F.col("stop")))
    got = {r.sample_id: [(x.major + k, x.minor) for x in r.runs for k in range(x.n)] for r in kept.collect()}
    assert got == trimmed({name: places for name, places in chunks.items() if places})
