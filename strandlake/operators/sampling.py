"""Seeded splits and samples by a hash of a key: the same rows on any cluster and in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_share(key: str, seed: int) -> Column:
    """A number in [0, 1) from seed and key."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / 2.0**32


def split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Rows with is_valid, true for about ``share`` of the keys."""
    return df.withColumn("is_valid", hashed_share(key, seed) < share)


def first_shuffled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first ``n`` rows of a seeded shuffle."""
    return df.orderBy(hashed_share(key, seed), key).limit(n)
