"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed to cells of source, language and topic. Raking scales
the cells, dimension after dimension and round after round, so that each dimension's marginal
reaches its target. A document's calibrated factor is its cell's raked weight
over its supply; documents are sampled with probability share times that factor,
by a hash of their id, so a repeated run samples the same documents.

No probability may be over 1, so raking is bounded: a cell's weight stops at its supply
over the share, and the other cells are raked to what is left. Where a value is so rare that its target can't be
met at the wished share, the caller chooses. By default the share is lowered to the largest one at which all targets are met. With
``keep_share`` the share stays: the rare value gives all it has, the other values of its dimension take the
rest in proportion to their targets, and what is missed is returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_or_empty

DIMENSIONS = ("source", "lang", "topic")
OUTPUT = ("mix_topic", "mix_tokens", "mix_factor", "mix_prob", "mix_miss", "sampled")
#: For each dimension the power to which its token shares are raised to give its targets: 1 keeps them, 0 makes all values equal.
TEMPERATURES = {"source": 0.5, "lang": 0.5, "topic": 0.7}
ROUNDS, SHARE, NONE = 8, 0.6, "(none)"
#: Raking goes on until all marginals are within this part of all tokens, and for so many rounds at most.
ERROR, MOST_ROUNDS = 1e-9, 2000
#: Cells that are broadcast, at most; more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def topic_of(text: str = "text") -> Column:
    """A topic by form: tables, marked-up, contact or prose."""
    body = text_or_empty(text)
    return (
        F.when(F.contains(body, F.lit(" | ")), "tables")
        .when(F.contains(body, F.lit("***")), "markup")
        .when(F.contains(body, F.lit("@")), "contact")
        .otherwise("prose")
    )


def token_weight(text: str = "text") -> Column:
    """Tokens by the rule of four bytes each, rounded up; an empty text weighs 1."""
    return F.greatest(F.ceil(F.octet_length(text_or_empty(text)) / 4), F.lit(1)).cast("double")


def _goals(name: str, values: np.ndarray, sums: np.ndarray, target: float | dict[str, float]) -> np.ndarray:
    """Target shares of a dimension's values, which add up to 1."""
    if isinstance(target, dict):
        named = np.array([v in target for v in values])
        left = max(0.0, 1.0 - sum(target.values()))
        goals = np.where(named, [float(target.get(v, 0.0)) for v in values], sums / (sums[~named].sum() or 1.0) * left)
    else:
        goals = np.power(sums, float(target))
    if not goals.sum() > 0:
        raise ValueError(f"no value of {name} has a target over 0")
    return goals / goals.sum()


def _bounded(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], share: float, rounds: int) -> tuple[np.ndarray, float]:
    """Probabilities, at most 1, that bring the marginals to share times the goals, and the largest error as a part of all tokens.

    A cell's probability is the product of a scale for each of its values, cut to 1. A step finds, for each value of a
    dimension, the scale by which the cut cells meet its goal: Newton's method on a concave function, from below.
    """
    total = tokens.sum()
    x, error = np.full(len(tokens), share), np.inf
    for done in range(1, MOST_ROUNDS + 1):
        for code, goal in zip(codes, goals, strict=True):
            n, to = len(goal), goal * share * total
            whole = np.bincount(code, tokens * x, n)
            scale = np.divide(to, whole, out=np.zeros(n), where=whole > 0)
            for _ in range(100):
                now = scale[code] * x
                free = np.bincount(code, np.where(now < 1, tokens * x, 0.0), n)
                miss = to - np.bincount(code, tokens * np.minimum(now, 1.0), n)
                move = np.divide(miss, free, out=np.zeros(n), where=(free > 0) & (miss > 0))
                if not (miss[free > 0] > ERROR * 1e-3 * total).any():
                    break
                scale += move
            # A value whose cells are all cut keeps them just there: larger scales would only grow from round to round.
            x = np.minimum(x * scale[code], 1e12)
        p = np.minimum(x, 1.0)
        error = max(np.abs(np.bincount(c, tokens * p, len(g)) / (share * total) - g).max() for c, g in zip(codes, goals, strict=True))
        if done >= rounds and error <= ERROR:
            break
    return np.minimum(x, 1.0), float(error)


def calibrate(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], share: float, rounds: int) -> tuple[np.ndarray, float]:
    """Probabilities of the cells and the share they sample: the wished one, or the largest below it at which all marginals meet their goals.

    Goals that no weights meet (a value and another that never stand together) are met as nearly as unbounded raking comes.
    """
    total = tokens.sum()
    meets = lambda error: error <= ERROR * 10
    # No value can give more than all of its tokens.
    high = min([share, *(float((np.bincount(c, tokens, len(g)) / total / np.where(g > 0, g, np.nan))[g > 0].min()) for c, g in zip(codes, goals, strict=True))])
    found, error = _bounded(tokens, codes, goals, high, rounds)
    if not meets(error):
        # So low a share that nothing is cut: what raking without a bound gives.
        low, tiny = 0.0, 1e-9
        free, _ = _bounded(tokens, codes, goals, tiny, rounds)
        low = min(high, tiny / free.max())
        found = free * (low / tiny)
        for _ in range(24):
            middle = (low + high) / 2
            tried, error = _bounded(tokens, codes, goals, middle, rounds)
            if meets(error):
                low, found = middle, tried
            else:
                high = middle
    return found, float((tokens * found).sum() / total)


def within_supply(goal: np.ndarray, supply: np.ndarray, wished: float) -> np.ndarray:
    """Tokens of each value: ``wished`` dealt by the goals; values that have less give all, and the others with a goal share the rest."""
    got, free, left = np.zeros(len(goal)), goal > 0, wished
    while free.any() and left > 0:
        want = np.where(free, goal, 0.0) / goal[free].sum() * left
        over = free & (want >= supply)
        if not over.any():
            return got + want
        got[over] = supply[over]
        left -= supply[over].sum()
        free &= ~over
    return got


def nearest(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], share: float, rounds: int) -> tuple[np.ndarray, float]:
    """Probabilities of the cells at the wished share, and the share they sample; values too rare for their goals give all they have.

    Where no probabilities meet such goals of several dimensions together, all goals move towards the present shares, by the smallest
    part at which they are met. Less than the share is sampled only where the values with a goal over 0 have no more tokens.
    """
    total = tokens.sum()
    free = tokens * np.all([goal[code] > 0 for code, goal in zip(codes, goals, strict=True)], axis=0)
    if not free.sum() > 0:
        return np.zeros(len(tokens)), 0.0
    share = min(share, float(free.sum() / total))
    supplies = [np.bincount(code, free, len(goal)) for code, goal in zip(codes, goals, strict=True)]
    dealt = [within_supply(goal, supply, share * total) / (share * total) for goal, supply in zip(goals, supplies, strict=True)]
    moved = lambda part: [(1 - part) * goal + part * supply / free.sum() for goal, supply in zip(dealt, supplies, strict=True)]
    found, error = _bounded(tokens, codes, dealt, share, rounds)
    if error > ERROR * 10:
        low, high, found = 0.0, 1.0, np.where(free > 0, share * total / free.sum(), 0.0)
        for _ in range(16):
            middle = (low + high) / 2
            tried, error = _bounded(tokens, codes, moved(middle), share, rounds)
            if error > ERROR * 10:
                low = middle
            else:
                high, found = middle, tried
    return found, float((tokens * found).sum() / total)


def missed(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    """For each cell, how far the share of one of its values stays below its goal at most; 0 where all are met."""
    reached = (tokens * prob).sum() or 1.0
    short = [(goal - np.bincount(code, tokens * prob, len(goal)) / reached)[code] for code, goal in zip(codes, goals, strict=True)]
    worst = np.max(short, axis=0)
    return np.where(worst > ERROR * 10, worst, 0.0)


def rake(
    cells: DataFrame, targets: dict[str, float | dict[str, float]], rounds: int = ROUNDS, share: float = SHARE, keep_share: bool = False
) -> DataFrame:
    """``cells`` (a column for each key of ``targets``, and tokens) plus prob, factor, whose token-weighted mean is 1, and miss.

    A target is a power of the present shares, or wished shares by value: values it does not name keep theirs,
    scaled to what the named ones leave. ``rounds``: at least so many, and more until the marginals are met.
    Cells, not documents, reach the driver: one row for each combination of values.
    """
    names = list(targets)
    rows = cells.select(*names, F.col("tokens").cast("double")).collect()
    schema = ", ".join([*(f"`{d}` string" for d in names), "tokens double, prob double, factor double, miss double"])
    if not rows:
        return cells.sparkSession.createDataFrame([], schema)
    tokens = np.array([r["tokens"] for r in rows])
    codes, goals = [], []
    for name in names:
        values, code = np.unique(np.array([r[name] for r in rows], dtype=object), return_inverse=True)
        codes.append(code)
        goals.append(_goals(name, values, np.bincount(code, tokens, len(values)), targets[name]))
    if not tokens.sum() > 0:
        raise ValueError("no document has a weight over 0")
    prob, reached = (nearest if keep_share else calibrate)(tokens, codes, goals, share, rounds)
    miss = missed(tokens, codes, goals, prob)
    out = [(*(r[d] for d in names), r["tokens"], float(p), float(p / reached) if reached else 0.0, float(m)) for r, p, m in zip(rows, prob, miss, strict=True)]
    return cells.sparkSession.createDataFrame(out, schema)


def uniform(id_col: str) -> Column:
    """A number in [0, 1) from the id's text."""
    head = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("double") / 2.0**32


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    targets: dict | None = None,
    rounds: int = ROUNDS,
    share: float = SHARE,
    topic: Column | None = None,
    tokens: Column | None = None,
    keep_share: bool = False,
) -> DataFrame:
    """``docs`` plus mix_topic, mix_tokens, mix_factor, mix_prob, mix_miss and sampled (columns of these names are replaced).

    ``share``: the part of all tokens to sample. Where a value is too rare for its target there, less is sampled (see ``calibrate``); with ``keep_share``
    the value gives all it has instead (see ``nearest``). mix_miss tells how far the share of one of the row's values stays below its target at most. ``topic`` and
    ``tokens``: a document's topic and weight, by default ``topic_of`` and ``token_weight``. A missing source, language or topic
    is a value too; a missing or negative weight is 0. Dimensions that ``targets`` leaves out are not raked. A target of 0 leaves a value out; a target for a value that no row has is
    passed over. Null texts are empty. Rows that share an id are sampled together if their cells agree.
    An empty table gives an empty result.
    """
    names = {d: fresh(docs, f"_mix_{d}") for d in (*DIMENSIONS, "tokens", "factor", "prob", "miss")}
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(text_col) if topic is None else topic}
    weight = token_weight(text_col) if tokens is None else F.greatest(F.coalesce(tokens.cast("double"), F.lit(0.0)), F.lit(0.0))
    keyed = docs.withColumns({names[d]: F.coalesce(value.cast("string"), F.lit(NONE)) for d, value in values.items()} | {names["tokens"]: weight})
    targets = targets or TEMPERATURES
    if not set(targets) <= set(DIMENSIONS):
        raise ValueError(f"targets are for {', '.join(DIMENSIONS)}, not {', '.join(sorted(set(targets) - set(DIMENSIONS)))}")
    cells = keyed.groupBy(*[F.col(names[d]).alias(d) for d in targets]).agg(F.sum(names["tokens"]).alias("tokens"))
    raked = rake(cells, targets, rounds, share, keep_share)
    raked = raked.select(*[F.col(d).alias(names[d]) for d in (*targets, "factor", "prob", "miss")])
    if raked.count() <= BROADCAST_CELLS:
        raked = F.broadcast(raked)
    joined = keyed.join(raked, [names[d] for d in targets])
    return joined.select(
        *[joined[f"`{c}`"] for c in docs.columns if c.lower() not in OUTPUT],
        F.col(names["topic"]).alias("mix_topic"),
        F.col(names["tokens"]).cast("long").alias("mix_tokens"),
        F.col(names["factor"]).alias("mix_factor"),
        F.col(names["prob"]).alias("mix_prob"),
        F.col(names["miss"]).alias("mix_miss"),
        (uniform(id_col) < F.col(names["prob"])).alias("sampled"),
    )
