"""Runs, islands, chunks and batches over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], begins: Column, name: str = "island") -> DataFrame:
    """Number islands of consecutive rows; ``begins`` is true where a new one begins (null counts as true)."""
    w = W.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_begins", F.coalesce(begins, F.lit(True)).cast("int"))
    return flagged.withColumn(name, F.sum("_begins").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_begins")


def run_length(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, run, start, length, value: maximal runs of equal values; start counts rows from 0."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_last", F.lag(value).over(w))
    begins = (F.col("_at") == 0) | ~F.col(value).eqNullSafe(F.col("_last"))
    runs = islands(rows, keys, order, begins, "run").groupBy(*keys, "run")
    return runs.agg(F.min("_at").cast("long").alias("start"), F.count(F.lit(1)).alias("length"), F.first(value).alias("value"))


def contiguous(df: DataFrame, keys: list[str], major: str = "major", minor: str = "minor") -> DataFrame:
    """Number contiguous pieces: a new one begins where major jumps by more than 1."""
    w = W.partitionBy(*keys).orderBy(major, minor)
    rows = df.withColumn("_before", F.lag(major).over(w))
    return islands(rows, keys, [major, minor], F.col("_before").isNull() | (F.col(major) - F.col("_before") > 1), "piece").drop("_before")


def depth_runs(df: DataFrame, keys: list[str], order: list[str], depth: str, least: int) -> DataFrame:
    """keys, start, end: maximal runs, in row numbers from 0, where depth reaches ``least``."""
    deep = df.select(*keys, *order, (F.col(depth) >= least).alias("_deep"))
    runs = run_length(deep, keys, order, "_deep").where("value")
    return runs.select(*keys, "start", (F.col("start") + F.col("length")).alias("end"))


def collapse_neighbours(df: DataFrame, keys: list[str], start: str, stop: str, seq: str) -> DataFrame:
    """Join pieces whose start is the last one's inclusive stop plus 1."""
    w = W.partitionBy(*keys).orderBy(start, stop)
    rows = df.withColumn("_before", F.lag(stop).over(w))
    joined = islands(rows, keys, [start, stop], F.col("_before").isNull() | (F.col(start) != F.col("_before") + 1), "piece")
    parts = F.array_sort(F.collect_list(F.struct(start, stop, seq)))
    return joined.groupBy(*keys, "piece").agg(
        F.min(start).alias(start), F.max(stop).alias(stop), F.array_join(F.transform(parts, lambda p: p[seq]), "").alias(seq)
    ).drop("piece")


def window_starts(n: Column, size: int, step: int) -> Column:
    """Starts of equal windows over ``n`` items; the last is moved back to end at ``n``. Fewer items than ``size`` give none."""
    last = n - size
    regular = F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))
    rest = F.when(last % step != 0, F.array(last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(last >= 0, F.concat(regular, rest))


def chunks(df: DataFrame, keys: list[str], order: list[str], size: int, overlap: int) -> DataFrame:
    """Rows with the chunk they belong to, several if chunks overlap: chunk (its first row number) and at (the row's place in it)."""
    w = W.partitionBy(*keys)
    rows = df.withColumn("_at", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))
    starts = F.filter(window_starts(F.col("_n"), size, size - overlap), lambda s: (s <= F.col("_at")) & (F.col("_at") < s + size))
    return rows.withColumn("chunk", F.explode(starts)).withColumn("at", F.col("_at") - F.col("chunk")).drop("_at", "_n")


def batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def interleave(df: DataFrame, keys: list[str], strand: str, order: list[str]) -> DataFrame:
    """Two strands spread uniformly: place is the rank of i/n within each strand, ties to the smaller strand value."""
    own = W.partitionBy(*keys, strand)
    rows = df.withColumn("_i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    rows = rows.withColumn("_share", F.col("_i") / F.col("_n"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_share", strand, *order)) - 1
    return rows.withColumn("place", place.cast("long")).drop("_i", "_n", "_share")


def round_robin(df: DataFrame, keys: list[str], source: str, order: list[str]) -> DataFrame:
    rows = df.withColumn("_turn", F.row_number().over(W.partitionBy(*keys, source).orderBy(*order)))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_turn", source)) - 1
    return rows.withColumn("place", place.cast("long")).drop("_turn")
