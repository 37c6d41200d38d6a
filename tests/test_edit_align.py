"""Edit alignment in chunks: fixed cases, the distance by brute force, pieces of long pairs, variants that turn one text into the other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import edit_align as E
from strandlake.operators import windows
from strandlake.plans import pipelines

from .test_whole_texts import edits as distance


def chained(query, ref, mode, chunk):
    return [(q0, q1, start, start + E.consumed(ops, "=XD"), E.cigar(ops)) for q0, q1, start, _, ops in E.chain(query, ref, chunk, 10_000, mode)]


# What each mode has to give at ends, whole and in chunks of four: query start and end, reference start and end, CIGAR, CIGARs of chunks.
ENDS = [
    ("GATCGGGATAGC", "ATCGGGATAG", "HWT", (1, 11, 0, 10, "10="), ["3=", "4=", "4=", "2="]),
    ("GATCGGGATAGC", "ATCGGGATAG", "HW", (0, 12, 0, 10, "1I10=1I"), ["1I3=", "4=", "4=", "2=1I"]),
    ("GATCGGGATAGC", "ATCGGGATAG", "NW", (0, 12, 0, 10, "1I10=1I"), ["1I3=", "4=", "4=", "2=1I"]),
    ("ATCGGGATAG", "GATCGGGATAGC", "HWT", (0, 10, 1, 11, "10="), ["4=", "4=", "4="]),
    ("ATCGGGATAG", "GATCGGGATAGC", "HW", (0, 10, 1, 11, "10="), ["4=", "4=", "4="]),
    ("ATCGGGATAG", "GATCGGGATAGC", "NW", (0, 10, 0, 12, "1D10=1D"), ["1D4=", "4=", "4=1D"]),
    ("GATCGGGATAGC", "CATCGGGATAGT", "HWT", (1, 11, 1, 11, "10="), ["3=", "4=", "4=", "2="]),
    ("GATCGGGATAGC", "CATCGGGATAGT", "HW", (0, 12, 0, 11, "1X10=1I"), ["1X3=", "4=", "4=", "2=1I"]),
    ("GATCGGGATAGC", "CATCGGGATAGT", "NW", (0, 12, 0, 12, "1X10=1X"), ["1X3=", "4=", "4=", "2=1X"]),
]


@pytest.mark.parametrize("query, ref, mode, whole, parts", ENDS)
def test_ends(query, ref, mode, whole, parts):
    assert chained(query, ref, mode, 1000) == [whole]
    got = chained(query, ref, mode, 4)
    assert [g[4] for g in got] == parts and (got[0][2], got[-1][3]) == whole[2:4]


# Length of a text against itself in chunks of five; reference start, reference end and length of each chunk.
CHUNKS = {
    5: [(0, 5, 5)], 6: [(0, 5, 5), (4, 6, 2)], 7: [(0, 5, 5), (4, 7, 3)], 8: [(0, 5, 5), (4, 8, 4)], 9: [(0, 5, 5), (4, 9, 5)], 10: [(0, 5, 5), (4, 10, 6)],
    11: [(0, 5, 5), (4, 9, 5), (8, 11, 3)], 12: [(0, 5, 5), (4, 9, 5), (8, 12, 4)], 13: [(0, 5, 5), (4, 9, 5), (8, 13, 5)], 14: [(0, 5, 5), (4, 9, 5), (8, 14, 6)],
}


@pytest.mark.parametrize("length", CHUNKS)
def test_chunks_share_one_match(length):
    text = "ATCGGGATAGATTG"[:length]
    assert [(r0, r1, q1 - q0) for q0, q1, r0, r1, _ in chained(text, text, "NW", 5)] == CHUNKS[length]


def walk(query, ref, at, ops):
    """Where operations end, after each has been held against the texts."""
    i = 0
    for n, op in ops:
        if op in "=X":
            assert all((a == b) == (op == "=") for a, b in zip(query[i : i + n], ref[at : at + n], strict=True))
        i, at = i + n * (op != "D"), at + n * (op != "I")
    return i, at


def mutated(rng, text, share, letters="ACGT"):
    return "".join(rng.choice(["", rng.choice(letters), c + rng.choice(letters)]) if rng.random() < share else c for c in text)


def test_paths_are_optimal():
    rng = random.Random(1)
    for _ in range(300):
        letters = rng.choice(["AC", "ACGT", "aé東x"])
        ref = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        query = mutated(rng, ref, rng.random() * 0.7, letters)
        edits, end, ops = E.path(query, ref)
        assert edits == distance(query, ref) == E.consumed(ops, "XID") and walk(query, ref, 0, ops) == (len(query), len(ref)) and end == len(ref)
        all_ends = [distance(query, ref[:k]) for k in range(len(ref) + 1)]
        edits, end, ops = E.path(query, ref, "SHW")
        assert (edits, end) == (min(all_ends), all_ends.index(min(all_ends))) and walk(query, ref, 0, ops) == (len(query), end)
        if query and len(ref) < 16:
            edits, start, ops = E.infix(query, ref)
            assert edits == min(distance(query, ref[a:b]) for a in range(len(ref) + 1) for b in range(a, len(ref) + 1)) and walk(query, ref, start, ops)[0] == len(query)


@pytest.mark.parametrize("chunk", [2, 7, 20])
def test_chains_cover_both_texts(chunk):
    rng = random.Random(chunk)
    for _ in range(150):
        ref = "".join(rng.choice("ACGT") for _ in range(rng.randrange(70)))
        query = mutated(rng, ref, rng.random() * 0.8) or "A"
        q, r = 0, 0
        for q0, q1, start, edits, ops in E.chain(query, ref, chunk, 20):
            assert q - q0 == r - start in (0, 1) and E.consumed(ops, "XID") == edits
            assert walk(query[q0:q1], ref, start, ops)[0] == q1 - q0
            q, r = q1, start + E.consumed(ops, "=XD")
        assert (q, r) == (len(query), len(ref))


def applied(ref, found):
    out, at = [], 0
    for pos, old, new in sorted(found):
        assert ref[pos : pos + len(old)] == old
        out += [ref[at:pos], new]
        at = pos + len(old)
    return "".join(out) + ref[at:]


def test_variants_turn_one_text_into_the_other():
    rng = random.Random(5)
    for _ in range(300):
        ref = "GATTACA" + "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 60)))
        query = "GATTACA" + mutated(rng, ref[7:], 0.15)
        _, _, ops = E.path(query, ref)
        found = list(E.variants_of(query, ref, 0, 0, ops))
        assert applied(ref, found) == query and all(old and new for _, old, new in found)
    assert list(E.variants_of("CAAT", "CAAAAT", 0, 0, E.path("CAAT", "CAAAAT")[2])) == [(0, "CAA", "C")]


def long_pairs(n):
    rng = random.Random(8)
    pairs = []
    for name in ("one", "two"):
        ref = "".join(rng.choice("ACGT") for _ in range(n))
        pairs.append((name, mutated(rng, ref, 0.01), ref))
    return [*pairs, ("same", "ACGT", "ACGT"), ("gone", "", "ACGT"), ("none", None, None), ("alien", "A" * 3000, "C" * 2000), ("new", "ACGTAC", "")]


def test_long_pairs_in_pieces(spark):
    pairs = long_pairs(60_000)
    df = spark.createDataFrame(pairs, "name string, query string, ref string")
    rows = E.align_long(df, chunk=2000, pad=500, piece=5000, anchor=16).orderBy("name", "piece", "part").collect()
    for name, query, ref in pairs:
        mine = [r for r in rows if r.name == name]
        q = r = total = 0
        for x in mine:
            assert q - x.q_start == r - x.start in (0, 1)
            ops = [(int(n), op) for n, op in __import__("re").findall(r"(\d+)(\D)", x.cigar)]
            q, r = x.q_end, walk(query[x.q_start : x.q_end], ref, x.start, ops)[1]
            total += x.edits
        if query:
            assert (q, r) == (len(query), len(ref))
        if name in ("one", "two"):
            assert len({x.piece for x in mine}) > 8 and len(mine) > 25 and total <= E.path(query, ref)[0] * 1.01
    assert not [r for r in rows if r.name in ("gone", "none")]


def test_variants_and_coverage_of_a_consensus(spark):
    name, query, ref = long_pairs(20_000)[0]
    pairs = spark.createDataFrame([(name, query, ref[:300] + ref), ("N", "ACGTTTTACGT", "ACGTNTTACGT")], "ref_name string, query string, seq string")
    kwargs = {"chunk": 2000, "pad": 500, "piece": 4000, "anchor": 16}
    found = pipelines.variants_of_consensus(pairs, mode="HW", ambiguous=True, **kwargs).collect()
    mine = [(r.pos, r.ref, r.alt) for r in found if r.ref_name == name]
    covered, gaps = pipelines.coverage_of_consensus(pairs, **kwargs)
    spans = {r.ref_name: (r.start, r.end) for r in covered.collect()}
    start, end = spans[name]
    assert applied(ref[:300] + ref, mine)[start : start + len(query)] == query and end == len(ref) + 300
    assert [(r.ref_name, r.start, r.end) for r in gaps.collect()] == [(name, 0, start)] and start > 0
    assert [r for r in found if r.ref_name == "N"] and not [r for r in pipelines.variants_of_consensus(pairs, **kwargs).collect() if r.ref_name == "N"]


def test_unknown_mode(spark):
    with pytest.raises(KeyError):
        E.align_long(spark.createDataFrame([("a", "A", "A")], "name string, query string, ref string"), mode="SW")


def test_windows_give_slices_and_bases(spark):
    rng = random.Random(2)
    contigs = {"a": "".join(rng.choice("ACGT") for _ in range(1000)), "b": "ACG", "none": None, "empty": ""}
    table = windows.windowed(spark.createDataFrame(list(contigs.items()), "ref_name string, seq string"), width=64)
    assert table.count() == 17
    spans = [("a", s, e) for s, e in ((0, 1000), (63, 65), (64, 128), (5, 5), (-3, 4), (990, 2000), (7, 3), (5, 5))] + [("b", 0, 9), ("empty", 0, 4), ("lost", 1, 2)]
    df = spark.createDataFrame(spans, "ref_name string, start long, end long").withColumn("bin", F.lit("mine"))
    got = sorted((r.ref_name, r.start, r.end, r.text) for r in windows.slices(df.drop("bin"), table, "ref_name", "start", "end", "text", 64).collect())
    assert got == sorted((n, s, e, (contigs.get(n) or "")[max(s, 0) : max(e, 0)]) for n, s, e in spans)
    bases = windows.base_at(df, table, "ref_name", "end", "base", 64).where("ref_name = 'a'").collect()
    assert sorted((r.end, r.base) for r in bases) == sorted((e, contigs["a"][e] if e < 1000 else None) for n, _, e in spans if n == "a" and e < 1024)


def test_slide_goes_past_all_matches():
    """Few or many diagonals, bytes or wide symbols, up to the ends of both texts; a long match takes a few steps."""
    rng = random.Random(12)
    for alphabet in ("AC", "A\xff", "Aα"):
        for _ in range(60):
            query, ref = ("".join(rng.choice(alphabet) * rng.choice((1, 1, 9, 70)) for _ in range(rng.randrange(1, 9))) for _ in range(2))
            pair = E._Pair(query, ref)
            for size in (1, E.FEW + 9):
                k = np.arange(size) - size // 2
                i = np.maximum(np.array([rng.randrange(-1, len(query) + 1) for _ in k]), -k)
                want = []
                for x, d in zip(i.tolist(), k.tolist(), strict=True):
                    while 0 <= x < len(query) and 0 <= x + d < len(ref) and query[x] == ref[x + d]:
                        x += 1
                    want.append(x)
                assert pair.slide(i, k).tolist() == want


def test_pieces_are_spread_over_tasks(spark):
    """Little text takes long to align, so its tasks are not merged by their bytes."""
    rows = spark.createDataFrame([(str(k), "ACGTACGT", "ACGAACGT") for k in range(400)], "name string, query string, ref string")
    assert E.align_long(rows).rdd.getNumPartitions() > 1
