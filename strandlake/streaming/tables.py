"""Structured Streaming forms of ordered operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_pileup(obs: DataFrame, time: str, window: str, delay: str) -> DataFrame:
    """Counts per reference, symbol and time window of a stream of observations; late rows are dropped after ``delay``."""
    spread = obs.withWatermark(time, delay).groupBy(F.window(time, window), "ref_name", "symbol")
    return spread.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "ref_name", "symbol", "n")


def streaming_runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, start, length, value: runs of equal values in a stream, each given once it has ended. The open run of a key is its state.

    Rows of a key come in order across micro-batches; within one they are sorted by ``order``.
    """
    kinds = dict(df.dtypes)

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, length, last = state.get if state.exists else (0, 0, None)
        rows = pd.concat(list(frames)).sort_values(order)
        done = []
        for item in rows[value]:
            if length and item == last:
                length += 1
            else:
                if length:
                    done.append((name[0], at, length, last))
                at, length, last = at + length, 1, item
        state.update((at, length, last))
        yield pd.DataFrame(done, columns=[key, "start", "length", "value"])

    return df.groupBy(key).applyInPandasWithState(
        run,
        f"{key} {kinds[key]}, start long, length long, value {kinds[value]}",
        f"at long, length long, last {kinds[value]}",
        "append",
        GroupStateTimeout.NoTimeout,
    )
