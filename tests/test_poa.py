"""Consensus of noisy sub-reads on a graph, and two alleles that differ in sequence only, against what was planted."""

import random

import pytest

from strandlake.operators import poa


def noisy(rng, text, share):
    out = []
    for c in text:
        x = rng.random()
        out.append("" if x < share / 3 else rng.choice("ACGT") if x < 2 * share / 3 else c + rng.choice("ACGT") if x < share else c)
    return "".join(out)


def planted(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_planted_molecule_at_ten_percent_errors(seed):
    rng = random.Random(seed)
    text = planted(rng, 120)
    got = poa.consensus([noisy(rng, text, 0.1) for _ in range(25)])
    from strandlake.operators.edit_align import path

    assert path(got, text)[0] <= 1


def test_small_groups():
    assert poa.consensus([]) == poa.consensus(["", ""]) == "" and poa.consensus(["ACGT"]) == "ACGT"
    assert poa.consensus(["ACGT", "ACGT", "AGT"]) == "ACGT" and poa.consensus(["ACGT", "AGT", "AGT"]) == "AGT"
    assert poa.consensus(["AC", "GGAC"], [5, 1]) == "AC"


def test_columns_hold_every_sequence():
    rng = random.Random(9)
    text = planted(rng, 40)
    reads = [noisy(rng, text, 0.2) for _ in range(8)]
    graph = poa.Graph()
    for r in reads:
        graph.add(r)
    assert sorted(graph.order) == list(range(len(graph.base)))
    assert ["".join(graph.base[v] for v in path) for path in graph.paths] == reads


def test_alleles_of_equal_length():
    rng = random.Random(3)
    one = planted(rng, 60).replace("AA", "AC").replace("CC", "CG")
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    two = "".join(other[c] if k in (10, 20, 30, 40, 50) else c for k, c in enumerate(one))
    reads = [noisy(rng, one, 0.02) for _ in range(9)] + [noisy(rng, two, 0.02) for _ in range(7)]
    assert poa.two_alleles(reads, [1] * 16) == [1] * 9 + [2] * 7
    assert poa.two_alleles([one, two], [9, 2]) == [1, 1] and poa.two_alleles([one, two], [9, 8]) == [1, 2]
    assert poa.two_alleles([one], [3]) == [1]


def test_groups_larger_than_a_graph(spark):
    rng = random.Random(4)
    texts = {k: planted(rng, 50) for k in ("a", "b")}
    rows = [(k, noisy(rng, t, 0.06)) for k, t in texts.items() for _ in range(30 if k == "a" else 3)] + [("a", texts["a"])] * 5 + [("b", texts["b"])] * 2 + [("none", None), ("none", "")]
    got = {r.k: r.seq for r in poa.molecule_consensus(spark.createDataFrame(rows, "k string, seq string"), ["k"], group=8).collect()}
    assert got == texts


def test_clusters_keep_their_rows(spark):
    rows = [(1, k, "ACGTACGTACGT" if k % 2 else "ACGTATGTACGT", "x") for k in range(8)] + [(1, 8, None, "x"), (2, 9, "AAAA", "x"), (2, 10, "AA", "x")]
    got = {r.read_id: r.cluster for r in poa.sequence_clusters(spark.createDataFrame(rows, "region long, read_id long, seq string, extra string"), ["region"]).collect()}
    assert {got[k] for k in (1, 3, 5, 7)} == {1} and {got[k] for k in (0, 2, 4, 6)} == {2} and got[8] == got[9] == got[10] == 1
