"""Long sequences as rows of fixed windows, so that no row and no plan carries a whole contig, and pieces of them by equi-joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases of a window.
WIDTH = 16_384


def windowed(contigs: DataFrame, key: str = "ref_name", seq: str = "seq", width: int = WIDTH) -> DataFrame:
    """key, bin, window: the bases [bin * width, (bin + 1) * width) of each contig. A null or empty sequence has no window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                bins = list(range(-(-len(text) // width)))
                # A few windows at a time: a contig may be hundreds of megabytes.
                for at in range(0, len(bins), 256):
                    some = bins[at : at + 256]
                    name = pa.array([batch.column(0)[k].as_py()] * len(some), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([name, pa.array(some, pa.int64()), pa.array([text[b * width : (b + 1) * width] for b in some])], names=[key, "bin", "window"])

    kind = dict(contigs.dtypes)[key]
    return contigs.select(key, seq).mapInArrow(cut, f"{key} {kind}, bin long, window string")


def base_at(rows: DataFrame, windows: DataFrame, key: str, pos: str, into: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with the base at ``pos`` (from 0) of their contig; null beyond its end. Rows of contigs without windows go, as in a join."""
    mine = windows.withColumnRenamed("bin", "_bin").withColumnRenamed("window", "_window")
    joined = rows.withColumn("_bin", F.floor(F.col(pos) / width)).join(mine, [key, "_bin"])
    base = F.substr("_window", (F.col(pos) % width + 1).cast("int"), F.lit(1))
    return joined.withColumn(into, F.when(base != "", base)).drop("_bin", "_window")


def slices(spans: DataFrame, windows: DataFrame, key: str, start: str, end: str, into: str, width: int = WIDTH) -> DataFrame:
    """``spans`` with the bases [start, end) of their contig as ``into``, clipped at its ends; empty where nothing is there.

    A span is put together from the windows it touches: two, mostly.
    """
    low, high = F.greatest(F.col(start), F.lit(0)), F.greatest(F.col(end), F.lit(0))
    bins = F.when(high > low, F.sequence(F.floor(low / width), F.floor((high - 1) / width)))
    rows = spans.select(F.monotonically_increasing_id().alias("_id"), F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("_row"), F.col(key), low.cast("long").alias("_low"), high.cast("long").alias("_high"), bins.alias("_bins"))
    # Numbered before they are spread over their windows.
    rows = rows.withColumn("bin", F.explode_outer("_bins")).drop("_bins")
    part = F.substr("window", (F.greatest(F.col("_low") - F.col("bin") * width, F.lit(0)) + 1).cast("int"), (F.least(F.col("_high") - F.col("bin") * width, F.lit(width)) - F.greatest(F.col("_low") - F.col("bin") * width, F.lit(0))).cast("int"))
    parts = rows.join(windows, [key, "bin"], "left").groupBy("_id").agg(F.first("_row").alias("_row"), F.array_sort(F.collect_list(F.when(F.col("window").isNotNull(), F.struct("bin", part.alias("part"))))).alias("_parts"))
    return parts.select("_row.*", F.array_join(F.transform("_parts", lambda p: p["part"]), "").alias(into))
