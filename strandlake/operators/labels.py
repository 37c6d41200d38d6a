"""Truth labels for positions, and encodings of them."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CLASS_SYMBOLS


def haploid_classes() -> list[str]:
    return list(CLASS_SYMBOLS)


def diploid_classes() -> list[str]:
    """Unordered pairs of symbols."""
    return ["".join(p) for p in combinations_with_replacement(CLASS_SYMBOLS, 2)]


def run_length_classes(max_run: int = 12) -> list[str]:
    """The gap, then each base with each run length."""
    return ["*1", *[f"{b}{k}" for b in CLASS_SYMBOLS[1:] for k in range(1, max_run + 1)]]


def encode(symbol: Column, classes: list[str]) -> Column:
    """The class number of a symbol, null if it is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, classes)), symbol) - 1, F.lit(-1)).cast("int")


def join_labels(columns: DataFrame, truth: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Columns with the truth's label at their position; positions without one have the gap's."""
    return columns.join(truth.select(*keys, "label"), keys, "left").withColumn("label", F.coalesce("label", F.lit(gap)))


def truth_labels(observations: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """ref_name, major, minor, label of one truth alignment's observations."""
    return observations.select("ref_name", "major", "minor", encode(F.col("symbol"), classes or haploid_classes()).alias("label"))


def accuracy(df: DataFrame, keys: list[str], label: str, predicted: str) -> DataFrame:
    """keys, n, correct, accuracy and its Q-score."""
    from ..functions.sequences import accuracy_quality

    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == F.col(predicted)).cast("long")).alias("correct"))
    share = sums.withColumn("accuracy", F.col("correct") / F.col("n"))
    return share.withColumn("q", accuracy_quality(F.col("accuracy")))


def training_vectors(labelled: DataFrame, keys: list[str], order: list[str], legacy: bool = False) -> DataFrame:
    """keys, truth: array of one-element arrays, the sparse class of each position in order, as losses over class probabilities take them.

    ``legacy`` labels are structs of ``code`` and run length; codes up to 4 are the gap, later ones count from 1.
    """
    label = F.greatest(F.col("label.code") - 4, F.lit(0)) if legacy else F.col("label")
    rows = F.array_sort(F.collect_list(F.struct(*order, label.cast("long").alias("_label"))))
    return labelled.groupBy(*keys).agg(F.transform(rows, lambda r: F.array(r["_label"])).alias("truth"))
