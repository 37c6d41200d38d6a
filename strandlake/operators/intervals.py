"""Interval algebra and interval joins: 0-based, half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, start: str = "start", end: str = "end", how: str = "overlap") -> DataFrame:
    """Pairs of intervals of one key that overlap (or, ``contain``: b within a), as columns a_* and b_*.

    Both sides are cut at multiples of ``width``, so the join is an equi-join on key and bin. A pair meets in several bins
    and is kept in the first they share, which needs no second shuffle. Empty intervals overlap nothing.
    """
    def binned(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]).where(F.col(f"{side}_{start}") < F.col(f"{side}_{end}"))
        bins = F.sequence(F.floor(F.col(f"{side}_{start}") / width), F.floor((F.col(f"{side}_{end}") - 1) / width))
        return named.withColumn("_bin", F.explode(bins)).select("*", *[F.col(f"{side}_{k}").alias(f"_{k}") for k in keys])

    joined = binned(a, "a").join(binned(b, "b"), ["_bin", *[f"_{k}" for k in keys]])
    meet = (F.col(f"a_{start}") < F.col(f"b_{end}")) & (F.col(f"a_{end}") > F.col(f"b_{start}"))
    if how == "contain":
        meet = (F.col(f"b_{start}") >= F.col(f"a_{start}")) & (F.col(f"b_{end}") <= F.col(f"a_{end}"))
    first = F.floor(F.greatest(f"a_{start}", f"b_{start}") / width)
    return joined.where(meet & (F.col("_bin") == first)).drop("_bin", *[f"_{k}" for k in keys])


def overlap_semi(a: DataFrame, b: DataFrame, keys: list[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Rows of ``a`` that overlap some row of ``b``."""
    slim = merge(b, keys, start, end)
    hits = overlap_join(a, slim.select(*keys, start, end), keys, width, start, end)
    return hits.select(*[F.col(f"a_{c}").alias(c) for c in a.columns]).distinct()


def points_in(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Points with the intervals they lie in, as columns p_* and i_*."""
    left = points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns]).withColumn("_bin", F.floor(F.col(f"p_{pos}") / width))
    right = intervals.select(*[F.col(c).alias(f"i_{c}") for c in intervals.columns]).where(F.col(f"i_{start}") < F.col(f"i_{end}"))
    right = right.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"i_{start}") / width), F.floor((F.col(f"i_{end}") - 1) / width))))
    same = [left[f"p_{k}"] == right[f"i_{k}"] for k in keys]
    inside = (F.col(f"p_{pos}") >= F.col(f"i_{start}")) & (F.col(f"p_{pos}") < F.col(f"i_{end}"))
    return left.join(right, [left["_bin"] == right["_bin"], *same]).where(inside).drop("_bin")


def _numbered(df: DataFrame, keys: list[str], start: str, end: str, touching: bool) -> DataFrame:
    """Intervals with the island they belong to; ``touching``: those that meet end to start are one island."""
    w = W.partitionBy(*keys).orderBy(start, end)
    rows = df.withColumn("_reach", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    gap = F.col(start) > F.col("_reach") if touching else F.col(start) >= F.col("_reach")
    rows = rows.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int"))
    return rows.withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_reach", "_new")


def merge(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", touching: bool = True) -> DataFrame:
    """keys, start, end, n: merged intervals and how many make one."""
    rows = _numbered(df.select(*keys, start, end), keys, start, end, touching).groupBy(*keys, "island")
    return rows.agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("island")


def with_islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", touching: bool = True) -> DataFrame:
    return _numbered(df, keys, start, end, touching)


def complement(df: DataFrame, lengths: DataFrame, keys: list[str], length: str = "length", start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end: what the intervals leave of [0, length)."""
    bounds = lengths.select(*keys, F.col(length).cast("long").alias("_length"))
    inside = df.join(bounds, keys).select(*keys, F.greatest(F.col(start), F.lit(0)).alias(start), F.least(F.col(end), F.col("_length")).alias(end))
    covered = merge(inside.where(F.col(start) < F.col(end)), keys, start, end).drop("n")
    marks = covered.unionByName(bounds.select(*keys, F.lit(0).cast("long").alias(start), F.lit(0).cast("long").alias(end)))
    marks = marks.unionByName(bounds.select(*keys, F.col("_length").alias(start), F.col("_length").alias(end)))
    w = W.partitionBy(*keys).orderBy(start, end)
    gaps = marks.withColumn("_from", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return gaps.where(F.col("_from") < F.col(start)).select(*keys, F.col("_from").alias(start), F.col(start).alias(end))


def split_regions(df: DataFrame, size: int, overlap: int = 0, fixed: bool = True, start: str = "start", end: str = "end") -> DataFrame:
    """Regions cut to pieces of ``size``. The last is moved back to full size (``fixed``) or short. Regions no longer than ``size`` stay."""
    step = size - overlap
    starts = F.sequence(F.col(start), F.greatest(F.col(start), F.col(end) - 1), F.lit(step).cast("long"))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("s"), F.least(s + size, F.col(end)).alias("e")))
    whole = F.filter(pieces, lambda p: (p["e"] - p["s"] == size) | (p["s"] == F.col(start)))
    if fixed:
        last = F.struct(F.greatest(F.col(start), F.col(end) - size).alias("s"), F.col(end).alias("e"))
        reached = F.element_at(whole, -1)["e"] == F.col(end)
        pieces = F.when(reached, whole).otherwise(F.concat(whole, F.array(last)))
    else:
        reach = F.array_max(F.transform(whole, lambda p: p["e"]))
        pieces = F.filter(pieces, lambda p: (p["e"] - p["s"] == size) | (p["s"] == F.col(start)) | (p["e"] > reach))
    others = [c for c in df.columns if c not in (start, end)]
    return df.withColumn("_piece", F.explode(pieces)).select(*others, F.col("_piece.s").alias(start), F.col("_piece.e").alias(end))


def clamp(start: Column, end: Column, pad: int, length: Column) -> tuple[Column, Column]:
    """Padded bounds within [0, length]."""
    return F.greatest(F.lit(0), start - pad), F.least(length, end + pad)


def arbitrate(df: DataFrame, keys: list[str], ident: str, least: int = 1000, ratio: float = 2.0, share: float = 0.5, width: int = 1000, start: str = "start", end: str = "end") -> DataFrame:
    """Resolve overlapping alignments: like lengths and much overlap drops both, little overlap trims both; unlike lengths drop the shorter or trim the second.

    Pairs are judged on original coordinates. Of several trims of one end, that of the last pair (by both starts) holds. What is left shorter than
    ``least`` goes.
    """
    rows = df.select(*keys, ident, start, end).withColumn("_size", F.col(end) - F.col(start))
    pairs = overlap_join(rows, rows, keys, width, start, end)
    before = (F.col(f"a_{start}") < F.col(f"b_{start}")) | ((F.col(f"a_{start}") == F.col(f"b_{start}")) & (F.col(f"a_{ident}") < F.col(f"b_{ident}")))
    pairs = pairs.where(before)
    low, high = F.greatest(f"a_{start}", f"b_{start}"), F.least(f"a_{end}", f"b_{end}")
    alike = F.greatest("a__size", "b__size") / F.least("a__size", "b__size") < ratio
    much = (high - low) / F.least("a__size", "b__size") >= share
    shorter_a = F.col("a__size") <= F.col("b__size")
    pair = F.struct(f"a_{start}", f"a_{ident}", f"b_{start}", f"b_{ident}")
    first = pairs.select(
        F.col(f"a_{ident}").alias(ident),
        pair.alias("_pair"),
        F.when(alike & ~much, low).alias("_end"),
        F.lit(None).cast("long").alias("_start"),
        (much & (alike | shorter_a)).alias("_drop"),
    )
    second = pairs.select(
        F.col(f"b_{ident}").alias(ident),
        pair.alias("_pair"),
        F.lit(None).cast("long").alias("_end"),
        F.when(~much, high).alias("_start"),
        (much & (alike | ~shorter_a)).alias("_drop"),
    )
    verdict = first.unionByName(second).groupBy(ident).agg(
        F.max("_drop").alias("_drop"),
        F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col("_pair"))).alias("_end"),
        F.max_by("_start", F.when(F.col("_start").isNotNull(), F.col("_pair"))).alias("_start"),
    )
    judged = df.join(verdict, ident, "left").where(~F.coalesce("_drop", F.lit(False)))
    judged = judged.withColumn(start, F.coalesce("_start", start)).withColumn(end, F.coalesce("_end", end)).drop("_drop", "_start", "_end")
    return judged.where(F.col(end) - F.col(start) >= least)


def best_overlap(a: DataFrame, b: DataFrame, keys: list[str], ident: str, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """For each interval of ``a`` the interval of ``b`` of most overlap (ties: smallest id), and their common window."""
    pairs = overlap_join(a, b, keys, width, start, end)
    low, high = F.greatest(f"a_{start}", f"b_{start}"), F.least(f"a_{end}", f"b_{end}")
    top = F.min(F.struct((low - high).alias("less"), F.col(f"b_{ident}").alias("b_id"), low.alias("s"), high.alias("e"))).alias("top")
    best = pairs.groupBy(*[F.col(f"a_{k}").alias(k) for k in keys], F.col(f"a_{ident}").alias("a_id")).agg(top)
    return best.select(*keys, "a_id", F.col("top.b_id").alias("b_id"), F.col("top.s").alias(start), F.col("top.e").alias(end))
