import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.llm import language, license_scan, mixing, quality, token_count, toxicity

from tests.test_oracle import rows as plain

from .conftest import prose

TOXIC = ["idiotic", "scummy", "worthless"]
SPEECH = {"en": "the and ing tion er was for that with", "fr": "le que ment eau tre les une dans est", "de": "der und ung sch keit ein ist das von"}


def made_up(rng, lang, n):
    parts = SPEECH[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(500):
        lang = rng.choice(list(SPEECH))
        words = made_up(rng, lang, rng.randrange(20, 120)).split()
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(TOXIC))
        if bad:
            words = [f"{w.upper()}!!" for w in words[:8]] * 5
            words += TOXIC[:1] if toxic else []
        docs.append((k, " ".join(words), lang, "s"))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(found, labels, k, held):
    truth = {row[0]: row[k] for row in labels if held(row[0])}
    got = {r.doc_id: r.predicted for r in found.collect() if r.doc_id in truth}
    return sum(got[i] == y for i, y in truth.items()) / len(truth)


def test_quality_held_out(labelled, awkward, empty):
    docs, labels, rows = labelled
    model = quality.train(docs, labels, quality.held_out())
    found = quality.score(docs, model)
    assert accuracy(found, rows, 1, lambda i: crc(i, 4) == 2) > 0.95
    assert found.where("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.7 as int)").count() == 0
    assert quality.score(awkward, model).where("score between 0 and 1").count() == 14 and quality.score(empty, model).count() == 0


def test_quality_interactions_are_linear_time_sum():
    import numpy as np

    model = quality.FactorisationMachine()
    rng = np.random.default_rng(1)
    model.w, model.v = rng.normal(size=model.w.shape), rng.normal(size=model.v.shape)
    items, x = np.array([3, 70, 900]), np.array([0.5, 1.0, 2.0])
    logits, _ = model._sums(1, np.zeros(3, dtype=int), items, x)
    pairs = sum(model.v[items[a]] @ model.v[items[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert abs(logits[0] - (model.w[items] @ x + pairs)) < 1e-9


def test_quality_without_labels(labelled):
    docs, labels, _ = labelled
    model = quality.train(docs, labels.limit(0), quality.held_out())
    assert quality.score(docs, model).where("score between 0 and 1").count() == 500


def test_toxicity_held_out(labelled, awkward, empty):
    docs, labels, rows = labelled
    weights, bias = toxicity.train(docs, labels, toxicity.held_out())
    found = toxicity.score(docs, weights, bias)
    assert accuracy(found, rows, 2, lambda i: crc(i, 5) == 0) > 0.95
    assert found.where("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert toxicity.score(awkward, weights, bias).where("score between 0 and 1").count() == 14
    assert toxicity.score(empty, weights, bias).count() == 0
    none, prior = toxicity.train(docs, labels.where("toxic = 0"), toxicity.held_out())
    assert not none.any() and toxicity.score(docs, none, prior).where("predicted = 0").count() == 500


def test_language_held_out(labelled, awkward, empty):
    docs, _, _ = labelled
    dictionaries = language.train(docs, held_out=language.held_out())
    assert set(dictionaries) == set(SPEECH)
    found = language.detect(docs, dictionaries).join(docs.select("doc_id", "lang"), "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2)
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count()
    odd = {r.doc_id: r for r in language.detect(awkward, dictionaries).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == "und" and odd[3].rejected and odd[3].score == 0
    assert odd[10].lang_pred in SPEECH and language.detect(empty, dictionaries).count() == 0
    kept = language.drop_rejected(awkward, dictionaries)
    assert kept.columns == awkward.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    assert language.detect(docs, {}).where("lang_pred = 'und' and rejected").count() == 500


def greedy(vocabulary, word):
    total = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), None)
        if k is None:
            return 1
        word, total = word[k:], total + 1
    return total


def test_automaton_is_greedy():
    rng = random.Random(8)
    for _ in range(60):
        vocabulary = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))}
        machine = token_count.Automaton(vocabulary)
        for _ in range(40):
            word = bytes(rng.choice(b"abc" if rng.random() < 0.1 else b"ab") for _ in range(rng.randrange(0, 14)))
            assert machine.count(word) == greedy(vocabulary, word), (vocabulary, word)


def test_token_counts(spark, awkward, empty):
    vocabulary = token_count.read_vocabulary(token_count.VOCABULARY)
    held = set(vocabulary)
    texts = ["Hello world, it's 2024!", "東京 café", "a_b  c\n\nd", "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_count.count_tokens(df, vocabulary).collect()}
    for k, t in enumerate(texts):
        words = token_count.WORD.findall(t)
        assert "".join(words) == t
        assert got[k] == (len(words), sum(greedy(held, w.encode()) for w in words))
    odd = {r.doc_id: r.n_tokens for r in token_count.count_tokens(awkward, vocabulary).collect()}
    assert odd[1] == odd[2] == 0 and odd[6] == odd[7] > 30_000 and token_count.count_tokens(empty, vocabulary).count() == 0


LICENSED = [
    "Released under the MIT License.",
    "mit License, apache\nlicense and Apache License; GNU General Public License general public license",
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided the following conditions are met",
    "redistribution and use in source",
    "smit license",
    "é MIT\x00LICENSE",
]


def test_license_matches_sql(spark, awkward, empty):
    rng = random.Random(3)
    texts = LICENSED + [f"{prose(rng, 90)} {t} {prose(rng, 70)}" for t in LICENSED] + [None, "", "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    frame = df.toPandas()
    con.register("documents", frame)
    want = con.execute(license_scan.oracle_sql()).df()
    got = license_scan.scan(df).toPandas()
    assert plain(got) == plain(want)
    assert got.set_index("doc_id").labels[0] == "mit" and got.set_index("doc_id").labels[4] == "bsd" and got.set_index("doc_id").labels[5] == ""
    assert license_scan.scan(awkward).count() == 14 and license_scan.scan(empty).count() == 0


def test_license_phrases_brute_force(spark):
    rng = random.Random(6)
    pool = "mit MIT license License LICENSE apache general public x , \n".split(" ")
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(80)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        places = [(i, label) for label, phrase in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r, at = got[k], [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))


def test_mixing_reaches_targets(spark, corpus, awkward, empty):
    targets = {"source": {"s0": 0.4, "s1": 0.3}, "lang": {"en": 0.5}, "topic": 1.0}
    mixed = mixing.mix(corpus, targets=targets, rounds=30)
    total = mixed.agg(F.sum("mix_tokens")).first()[0]
    share = {r.source: r.s / total for r in mixed.groupBy("source").agg(F.sum(F.col("mix_tokens") * F.col("mix_factor")).alias("s")).collect()}
    assert abs(share["s0"] - 0.4) < 1e-6 and abs(share["s1"] - 0.3) < 1e-6
    lang = {r.lang: r.s / total for r in mixed.groupBy("lang").agg(F.sum(F.col("mix_tokens") * F.col("mix_factor")).alias("s")).collect()}
    assert abs(lang["en"] - 0.5) < 1e-6
    again = mixing.mix(corpus.repartition(3), targets=targets, rounds=30)
    assert {r.doc_id for r in mixed.where("sampled").collect()} == {r.doc_id for r in again.where("sampled").collect()}
    odd = mixing.mix(awkward)
    assert odd.count() == 14 and odd.where("mix_prob is null or mix_prob < 0 or mix_prob > 1").count() == 0 and mixing.mix(empty).count() == 0
    assert set(awkward.columns) < set(odd.columns)
