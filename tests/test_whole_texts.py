"""Queries over whole texts against brute force on a small fixture whose texts differ only beyond the old cuts."""

import re

import pytest

from strandlake.operators import align
from strandlake.plans.queries import QUERIES


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


DOCS = [(0, "abcdé" * 60), (1, "abcdé" * 55 + "tail of its own"), (2, "plain"), (3, "plane é"), (5, "alone")]
TURNS = [(k, t, f"{head}{t}{tail}") for k, head, tail in ((0, "cab", "dZ"), (1, "bad", "dad"), (2, "one two three four", " é five")) for t in range(6)]
TURNS = [(c, t, re.sub("[0-9]", "a" * 45, x)) for c, t, x in TURNS] + [(3, 0, "aaa"), (3, 2, "bbb"), (3, 3, "ccc"), (4, 0, None)]
LETTERS = ["ACGTACGTTA", "ACGTACGTTC", "GATTACAGATTACAGATTACAGATTACAT", "GATTACAGATTACAGATTACAGATTACAG", "T"]
ITEMS = [(k, f"{LETTERS[k % 5]} {'x' * (k % 3)}{'G' * (k // 5)}") for k in range(20)] + [(21, "xyz")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    for name, data, schema in (
        ("documents", DOCS, "doc_id long, text string"),
        ("conversations", TURNS, "conv_id long, turn int, text string"),
        ("benchmark", ITEMS, "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_edits_of_whole_documents(spark, folder):
    got = {r.name: (r.edits, r.aligned, r.spanned) for r in QUERIES["aln3_chunked_edits"](spark, folder).collect()}
    for k, text in DOCS:
        plain = re.sub("[^\x02-\x7f]", "~", text)
        query = re.sub("(.{210}).", r"\1", re.sub("(.{96}).", "\\1\x01", plain))
        assert got[k] == (edits(query, plain), len(query), len(plain))
    assert got[0][0] == 4


def test_symbols_of_whole_texts(spark, folder):
    got = {(r.conv_id, r.turn): (r.valid, r.n_valid) for r in QUERIES["flt11_valid_symbols"](spark, folder).collect()}
    fits = lambda x: re.fullmatch("[A-Ta-t]*", x) is not None
    assert got == {(c, t): (None, None) if x is None else (fits(x), sum(map(fits, x.split(" ")))) for c, t, x in TURNS}
    assert {v for v, _ in got.values()} == {True, False, None}


def test_neighbours_of_all_turns(spark, folder):
    got = {(r.conv_id, r.start, r.stop): r.seq for r in QUERIES["win9_collapse_neighbours"](spark, folder).collect()}
    want = {(k, 0, 5): "".join(x for c, _, x in TURNS if c == k) for k in (0, 1, 2)}
    assert got == want | {(3, 0, 0): "aaa", (3, 2, 3): "bbbccc", (4, 0, 0): ""}


def test_consensus_of_all_turns(spark, folder):
    """Turns of a conversation have the same letters here, so those are their consensus, beyond 40 letters too."""
    got = {r.conv_id: r.seq for r in QUERIES["aln6_star_consensus"](spark, folder).collect()}
    for k in (0, 1, 2):
        letters = {re.sub("[^A-Z]", "", x.upper()) for c, _, x in TURNS if c == k}
        assert letters == {got[k]} and len(got[k]) > 40
    assert len(got[3]) == 3 and 4 not in got


def test_reads_by_all_alleles(spark, folder):
    reads = [(k, re.sub("[^ACGT]", "", t.upper())) for k, t in ITEMS]
    reads = [(k, s) for k, s in reads if s]
    want = {}
    for k, s in reads:
        haps = sorted({t for j, t in reads if j % 5 == k % 5})
        scores = [align.align_pair(s, h)[0] for h in haps]
        allele = -1 if len(haps) > 1 and len(set(scores)) == 1 else scores.index(max(scores))
        n, total = want.get((k % 5, k % 2 == 1, allele), (0, 0))
        want[k % 5, k % 2 == 1, allele] = n + 1, total + max(scores)
    got = {(r.site, r.is_rev, r.allele): (r.n, r.score) for r in QUERIES["agg15_ambiguous_alleles"](spark, folder).collect()}
    assert got == want and max(a for _, _, a in got) > 1
