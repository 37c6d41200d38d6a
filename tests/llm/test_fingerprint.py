"""Fingerprints of documents: peeling, likeness and the query against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import fingerprint

from .conftest import prose

TEXTS = ["", " ", "\n\n", "one", "a.b.c d. e", "...! ? x", "x" * 1000, "many words in a line without an end " * 40, "é 東京. " * 9, "tab\tand\vmore\n\nlast"]


def likeness(a, b):
    """Multiset likeness of paragraphs."""
    one, two = Counter(fingerprint.paragraphs(a)), Counter(fingerprint.paragraphs(b))
    return sum((one & two).values()) / sum((one | two).values()) if one | two else 1.0


def test_paragraphs_are_the_text():
    rng = random.Random(1)
    for text in TEXTS + ["".join(rng.choice("ab .!?\n\t") for _ in range(rng.randrange(300))) for _ in range(200)]:
        pieces = fingerprint.paragraphs(text)
        assert "".join(pieces) == text and all(pieces) and max(map(len, pieces), default=0) <= fingerprint.PARAGRAPH_CHARS


def test_peeling_recovers_differences():
    rng = np.random.default_rng(2)
    sets = [[rng.choice(5000, size=k, replace=False).astype(np.uint64) for k in sizes] for sizes in ((0, 0), (1, 0), (40, 3), (900, 900), (2000, 1))]
    sets.append([sets[3][0], sets[3][0]])
    one, two = (fingerprint.stacked([fingerprint.mix64(s[k] + np.uint64(1)) for s in sets]) for k in (0, 1))
    row, key, sign, took = fingerprint.differences(one, two, len(sets))
    for k, (a, b) in enumerate(sets):
        a, b = (set(fingerprint.mix64(x + np.uint64(1)).tolist()) for x in (a, b))
        assert set(key[(row == k) & (sign > 0)].tolist()) == a - b and set(key[(row == k) & (sign < 0)].tolist()) == b - a
    assert took[0] == took[5] == fingerprint.CELLS and took[3] > took[1]


def test_fingerprints_compare():
    rng = random.Random(3)
    text = prose(rng, 300)
    other = text.replace(text.split()[150], "changed", 1)
    one, two = (fingerprint.written(*fingerprint.stacked([fingerprint.digests(t)]), 1)[0] for t in (text, other))
    removed, added, near = fingerprint.compare(one, two)
    assert len(removed) == len(added) == 1 and near == pytest.approx(likeness(text, other))
    assert fingerprint.compare(one, one) == ([], [], 1.0)
    assert fingerprint.compare(one, fingerprint.written(*fingerprint.stacked([fingerprint.digests(prose(rng, 300))]), 1)[0]) is None


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(text, edited), 9), round(likeness(text, after), 9)))
    return sorted(out, key=repr)


def query(docs):
    got = fingerprint.fingerprints_of_edits(docs).collect()
    by_print = {}
    for r in got:
        by_print.setdefault(r.doc_id, r.fingerprint)
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr)


def test_query_matches_brute_force(spark, awkward, corpus):
    for docs in (awkward, corpus, awkward.select("doc_id", "text").unionByName(corpus.select("doc_id", "text")).repartition(7)):
        assert query(docs) == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_hot_id_and_repeats(spark):
    rng = random.Random(4)
    shared = prose(rng, 30)
    rows = [(None, shared)] * 300 + [(5, f"{k} {prose(rng, 9)}") for k in range(300)] + [(k, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert query(docs) == expected(rows)


def test_one_document_none_and_clashing_columns(spark, empty):
    one = spark.createDataFrame([(3, "just. this one.")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("digest", "place", "edge", "i", "d", "a.b")})
    assert query(one) == expected([(3, "just. this one.")]) and query(one)[0][3:] != ()
    assert query(empty) == []


def test_equal_texts_have_equal_fingerprints(spark, corpus):
    got = fingerprint.fingerprints_of_edits(corpus).join(corpus.select("doc_id", "text"), "doc_id")
    assert got.groupBy("text").agg(F.count_distinct("fingerprint").alias("n")).where("n > 1").isEmpty()


def test_differing_paragraphs(spark):
    rows = [(1, "a. b. c.", "a. x. c."), (2, None, ""), (3, "same", "same"), (4, None, "new text")]
    got = {r.id: r for r in fingerprint.differing_paragraphs(spark.createDataFrame(rows, "id long, old string, new string")).collect()}
    assert (len(got[1].removed), len(got[1].added), round(got[1].likeness, 3)) == (1, 1, 0.5)
    assert [got[k].likeness for k in (2, 3, 4)] == [1.0, 1.0, 0.0] and len(got[4].added) == 1
