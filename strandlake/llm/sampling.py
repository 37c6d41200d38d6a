"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int, scratch: Scratch, columns: tuple[str, ...] = ()) -> DataFrame:
    """label, text and ``columns`` of at most ``rows`` labelled documents, those of least id hash, of which none is held out; written.

    Ids are chosen among those that have both a label and a document, and an id counts once: of rows that share it, the least
    text, and the largest label. The chosen ids are bounded by ``rows``, so they are broadcast and texts are only scanned.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    known = scratch.write(known.withColumn("h", F.xxhash64(F.lit("labelled sample"), "doc_id")), "labelled")
    n = known.count()
    if n > 2 * rows:
        # Hashes are uniform: the least ones lie below this bound, so that few candidates are sorted, however many labels there are.
        known = known.where(F.col("h") < F.lit(int(-(2**63) + 2**64 * 1.5 * rows / n)))
    picked = scratch.write(known.orderBy("h", "doc_id").limit(rows).select(F.col("doc_id").alias("_picked"), "label"), "picked")
    rows_of = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(text_or_empty("text").alias("text"), *columns).alias("row"))
    found = rows_of.join(F.broadcast(picked), F.col("_id") == F.col("_picked"))
    found = found.groupBy("_picked", "label").agg(F.min("row").alias("row"))
    return scratch.write(found.select("label", "row.*"), "sample")
