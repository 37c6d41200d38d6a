"""Marginals of the probabilities, which are what a sample meets, not of the factors."""

import hashlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import mixing
from strandlake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def marginals(tokens, codes, goals, prob):
    return [np.bincount(c, tokens * prob, len(g)) / (tokens * prob).sum() for c, g in zip(codes, goals, strict=True)]


@pytest.mark.parametrize(("goal", "share", "reached"), [(0.15, 0.6, 0.6), (0.3, 0.6, 1 / 3), (0.1, 0.6, 0.6)])
def test_probabilities_meet_goals(goal, share, reached):
    """A value with a tenth of all tokens: its goal can be met at the wished share, or at the largest share its supply allows."""
    rng = np.random.default_rng(1)
    codes = [np.repeat([0, 1, 2], 12), np.tile([0, 1, 2, 3], 9)]
    tokens = rng.uniform(1, 9, 36)
    for k, part in enumerate((0.1, 0.5, 0.4)):
        tokens[codes[0] == k] *= part / tokens[codes[0] == k].sum()
    goals = [np.array([goal, 0.5, 0.5 - goal]), np.array([0.3, 0.3, 0.2, 0.2])]
    prob, got = mixing.calibrate(tokens, codes, goals, share, 8)
    assert prob.max() <= 1 and prob.min() >= 0 and abs(got - reached) < 1e-4
    for found, want in zip(marginals(tokens, codes, goals, prob), goals, strict=True):
        assert np.abs(found - want).max() < 1e-6


def test_small_values_are_lifted(spark):
    """A source of a third of all rows, and a small one with a wished share."""
    rows = [(k, "word " * (5 + k % 40) + (" | " if k % 11 == 0 else ""), "en" if k % 4 else "fr", "big" if k % 3 == 0 else "tiny" if k % 20 == 1 else f"s{k % 5}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(docs, targets={"source": {"tiny": 0.25}, "lang": 0.5, "topic": 0.7})
    assert mixed.where("mix_prob > 1 or mix_prob < 0").count() == 0
    weight = F.sum(F.col("mix_tokens") * F.col("mix_prob"))
    reached = mixed.agg(weight).first()[0]
    share = {r.source: r.s / reached for r in mixed.groupBy("source").agg(weight.alias("s")).collect()}
    assert abs(share["tiny"] - 0.25) < 1e-6
    for column, power in (("lang", 0.5), ("mix_topic", 0.7)):
        sums = {r[0]: (r[1], r[2]) for r in mixed.groupBy(column).agg(F.sum("mix_tokens"), weight).collect()}
        norm = sum(n**power for n, _ in sums.values())
        assert all(abs(w / reached - n**power / norm) < 1e-6 for n, w in sums.values())


def test_goals_that_nothing_meets_end():
    """Two values that always stand together, with goals that differ."""
    codes = [np.array([0, 1]), np.array([0, 1])]
    prob, share = mixing.calibrate(np.array([1.0, 1.0]), codes, [np.array([0.9, 0.1]), np.array([0.5, 0.5])], 0.6, 8)
    assert (prob >= 0).all() and (prob <= 1).all() and share > 0


@pytest.mark.parametrize(("goal", "share"), [(0.15, 0.6), (0.3, 0.6), (0.9, 0.5)])
def test_share_is_kept(goal, share):
    """A value with a tenth of all tokens gives what it has; the others share the rest by their goals, and the second dimension is met."""
    rng = np.random.default_rng(1)
    codes = [np.repeat([0, 1, 2], 12), np.tile([0, 1, 2, 3], 9)]
    tokens = rng.uniform(1, 9, 36)
    for k, part in enumerate((0.1, 0.5, 0.4)):
        tokens[codes[0] == k] *= part / tokens[codes[0] == k].sum()
    rest = (1 - goal) / 2
    goals = [np.array([goal, rest, rest]), np.array([0.3, 0.3, 0.2, 0.2])]
    prob, got = mixing.nearest(tokens, codes, goals, share, 8)
    assert prob.max() <= 1 and prob.min() >= 0 and abs(got - share) < 1e-6
    first = min(goal, 0.1 / share)
    want = [np.array([first, (1 - first) / 2, (1 - first) / 2]), goals[1]]
    for found, wanted in zip(marginals(tokens, codes, goals, prob), want, strict=True):
        assert np.abs(found - wanted).max() < 1e-6
    miss = mixing.missed(tokens, codes, goals, prob)
    assert miss[codes[0] == 0] == pytest.approx(goal - first, abs=1e-6) and (miss[codes[0] != 0] == 0).all()


def test_one_rare_value_does_not_lower_the_share(spark):
    rows = [(k, "some words here" + (" @" if k == 7 else " ..") + " and more" * 3, "en", "web") for k in range(200)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), keep_share=True)
    kept, every = mixed.agg(F.sum(F.col("mix_tokens") * F.col("mix_prob")), F.sum("mix_tokens")).first()
    assert abs(kept / every - 0.6) < 1e-6
    rare = mixed.where("mix_topic = 'contact'").first()
    assert rare.mix_prob == 1 and rare.mix_miss > 0.01 and mixed.where("mix_miss = 0").count() == 199


def slow_error(tokens, goals):
    """How far plain bisection of one scale for each value stays from the tokens that ``goals`` ask of each value."""
    scale = [dict.fromkeys(g, 1.0) for g in goals]
    raw = lambda cell: np.prod([scale[d][v] for d, v in enumerate(cell)])
    for _ in range(40):
        for d, part in enumerate(goals):
            for value, goal in part.items():
                scale[d][value] = 1.0
                cells = [(n, raw(c)) for c, n in tokens.items() if c[d] == value]
                low, high = 0.0, 1 / min(x for _, x in cells)
                for _ in range(50):
                    middle = (low + high) / 2
                    low, high = (middle, high) if sum(n * min(1.0, x * middle) for n, x in cells) < goal else (low, middle)
                scale[d][value] = high
    got = [dict.fromkeys(g, 0.0) for g in goals]
    for cell, n in tokens.items():
        for d, v in enumerate(cell):
            got[d][v] += n * min(1.0, raw(cell))
    return max(abs(got[d][v] - goal) for d, part in enumerate(goals) for v, goal in part.items())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")
def test_query_is_the_bounded_raking(spark):
    """The whole query from its definition: marginals on the line from the goals to the present shares, as near to the goals as can be,
    and probabilities that are products of a scale for each value, cut to 1. Only one set of probabilities is such."""
    rows, tokens = {}, defaultdict(float)
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        text = r.text or ""
        topic = "tables" if " | " in text else "markup" if "***" in text else "contact" if "@" in text else "prose"
        weight = max(-(-len(text.encode()) // 4), 1)
        cell = (r.source or mixing.NONE, r.lang or mixing.NONE, topic)
        rows[r.doc_id] = (cell, weight)
        tokens[cell] += weight
    got = QUERIES["op4_mixing"](spark, DATA).collect()
    assert len(got) == len(rows)
    prob = {}
    for r in got:
        cell, weight = rows[r.doc_id]
        assert (r.topic, r.tokens) == (cell[2], weight) and prob.setdefault(cell, r.prob) == r.prob
        place = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) / 2**32
        assert abs(place - r.prob) < 1e-5 or r.sampled == (place < r.prob)
    kept = mixing.SHARE * sum(tokens.values())
    assert sum(tokens[c] * p for c, p in prob.items()) == pytest.approx(kept, rel=1e-5)
    goals, present, reached = [], [], []
    for d, power in enumerate(mixing.TEMPERATURES.values()):
        supply, out = defaultdict(float), defaultdict(float)
        for cell, n in tokens.items():
            supply[cell[d]] += n
            out[cell[d]] += n * prob[cell]
        part, left, open_values = {}, kept, set(supply)
        while open_values:
            norm = sum(supply[v] ** power for v in open_values)
            full = {v for v in open_values if supply[v] ** power / norm * left >= supply[v]}
            part |= {v: supply[v] if full else supply[v] ** power / norm * left for v in full or open_values}
            left -= sum(supply[v] for v in full)
            open_values = open_values - full if full else set()
        goals.append(part)
        present.append({v: mixing.SHARE * n for v, n in supply.items()})
        reached.append(out)
    points = [(goals[d][v], present[d][v], reached[d][v]) for d in range(3) for v in goals[d]]
    moved = sum((x - g) * (p - g) for g, p, x in points) / sum((p - g) ** 2 for g, p, _ in points)
    assert -1e-6 < moved < 1 and max(abs(g + moved * (p - g) - x) for g, p, x in points) < 1e-4 * kept
    if moved > 1e-4:
        assert slow_error(tokens, [{v: g + 0.8 * moved * (present[d][v] - g) for v, g in part.items()} for d, part in enumerate(goals)]) > 1e-4 * kept
    values = sorted({(d, c[d]) for c in tokens for d in range(3)})
    at = {v: k for k, v in enumerate(values)}
    table = {c: np.bincount([at[d, c[d]] for d in range(3)], minlength=len(values)) for c in prob}
    inner = [c for c, p in prob.items() if 1e-3 < p < 1 - 1e-6]
    scales, *_ = np.linalg.lstsq(np.array([table[c] for c in inner], dtype=float), np.log([prob[c] for c in inner]), rcond=None)
    assert max(abs(table[c] @ scales - np.log(prob[c])) for c in inner) < 1e-2
