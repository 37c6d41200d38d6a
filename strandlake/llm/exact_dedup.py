"""Exact deduplication by a tree-merge of sorted digest runs.

Rows are dealt into ``radix ** rounds`` runs. Each run is sorted by SHA-256
digest and holds a digest once, with the largest row identifier and the number
of copies. In every round, ``radix`` runs exchange their entries: the next digit of a run's
address is taken from the digest instead of the run number, so after the
last round a digest has one address and its entry is final. An entry is merged
only with entries of the same full digest and byte length, so every
level keeps verified identifiers.

A group of copies that holds a third of all rows shrinks to at most one entry a run
before anything else is exchanged; the way down joins run entries to final
ones and rows to run entries, so such a group is never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_found, text_digest, text_or_empty


def digests(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, a row number unique in the table, digest and byte length; written once."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_digest(text_col).alias("digest"),
        F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    return scratch.write(rows, "digests")


def exact_groups(rows: DataFrame, radix: int = 8, rounds: int = 2) -> DataFrame:
    """``digests`` plus keep_id, group_size and kept. The row with the largest id stays; of rows that share that id too, one.

    Null ids count as smallest. Null text is empty text. An empty table gives an empty result.
    """
    runs = radix**rounds
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row_no"), F.lit(runs)))
    entries = rows.groupBy("run", "digest", "n_bytes").agg(
        F.max(F.struct("doc_id", "row_no")).alias("top"), F.count(F.lit(1)).alias("copies")
    )
    merged = entries
    code = F.pmod(F.xxhash64("digest"), F.lit(runs))
    for level in range(1, rounds + 1):
        own = radix ** (rounds - level)
        address = F.floor(code / own) * own + F.pmod(F.col("run"), F.lit(own))
        merged = (
            merged.withColumn("run", address)
            .groupBy("run", "digest", "n_bytes")
            .agg(F.max("top").alias("top"), F.sum("copies").alias("copies"))
        )
    final = merged.where("copies > 1").select("digest", "n_bytes", "top", "copies")
    down = entries.select("run", "digest", "n_bytes").join(final, ["digest", "n_bytes"])
    found = rows.join(down, ["run", "digest", "n_bytes"], "left")
    alone = F.col("top").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("top.row_no") == F.col("row_no"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "digest",
        "row_no",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = 8, rounds: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``, dropped ones too; cases as in ``exact_groups``.

    Other columns are not read; texts are read whole, however long.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(digests(docs, scratch, id_col, text_col))
        return exact_groups(rows, radix, rounds).drop("digest", "row_no")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its dropped copies, columns as they are. Rows that repeat wholly (id and text) leave one row."""
    with Scratch(docs.sparkSession) as scratch:
        found = exact_groups(digests(docs, scratch, id_col, text_col))
        return keep_found(docs, found, scratch, id_col, text_col)
