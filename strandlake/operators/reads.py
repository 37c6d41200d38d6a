"""Filters on alignments and the walk from CIGAR strings to base observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import ON_READ, ON_REFERENCE, cigar_ops, reference_end

#: Flag bits of unmapped, secondary, QC-failed, duplicate and supplementary alignments.
UNWANTED = 0x4 | 0x100 | 0x200 | 0x400 | 0x800
REVERSE = 0x10


def primary(df: DataFrame, min_mapq: int = 1) -> DataFrame:
    return df.where((F.col("flag").bitwiseAND(UNWANTED) == 0) & (F.col("mapq") >= min_mapq))


def with_tag(df: DataFrame, name: str, value: int, keep_missing: bool = False) -> DataFrame:
    """Reads whose integer tag equals ``value``; those without it only if ``keep_missing``; a tag that is no integer drops its read."""
    if len(name) != 2:
        raise ValueError(f"a tag name has two characters, not {name!r}")
    held = F.map_contains_key(F.coalesce("tags", F.create_map().cast("map<string,string>")), F.lit(name))
    equal = F.coalesce(F.element_at("tags", F.lit(name)).try_cast("int") == value, F.lit(False))
    return df.where(F.when(held, equal).otherwise(F.lit(keep_missing)))


def of_read_group(df: DataFrame, group: str) -> DataFrame:
    return df.where(F.coalesce(F.element_at("tags", F.lit("RG")) == group, F.lit(False)))


def clamp_regions(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Regions with open ends filled and bounds clamped to [0, length]; an unknown contig is an error."""
    known = contigs.select(F.col("ref_name").alias("_name"), F.col("length").alias("_length"))
    joined = regions.join(known, F.col("ref_name") == F.col("_name"), "left")
    length = F.when(F.col("_length").isNull(), F.raise_error(F.concat(F.lit("unknown contig "), "ref_name"))).otherwise(F.col("_length"))
    return joined.select(
        "ref_name",
        F.greatest(F.lit(0).cast("long"), F.coalesce("start", F.lit(0).cast("long"))).alias("start"),
        F.least(length, F.coalesce("end", length)).cast("long").alias("end"),
    )


def spanning(reads: DataFrame, regions: DataFrame, width: int, partial: bool = False) -> DataFrame:
    """Reads with the regions they cover wholly (``partial``: overlap), as columns a_* (read) and b_* (region)."""
    from .intervals import overlap_join

    placed = reads.withColumn("start", F.col("pos")).withColumn("end", reference_end(F.col("pos"), F.col("cigar")))
    return overlap_join(placed, regions, ["ref_name"], width, how="overlap" if partial else "contain")


def placed_ops(cigar: Column, pos: Column) -> Column:
    """array<struct<op, n, ref, read>>: each operation with where it begins on the reference and on the read."""
    start = F.struct(
        F.array().cast("array<struct<op:string,n:int,ref:bigint,read:int>>").alias("out"), pos.cast("long").alias("ref"), F.lit(0).alias("read")
    )

    def step(s: Column, o: Column) -> Column:
        on_ref = F.when(F.contains(F.lit(ON_REFERENCE), o["op"]), o["n"]).otherwise(0)
        on_read = F.when(F.contains(F.lit(ON_READ), o["op"]), o["n"]).otherwise(0)
        placed = F.struct(o["op"].alias("op"), o["n"].alias("n"), s["ref"].alias("ref"), s["read"].alias("read"))
        return F.struct(F.concat(s["out"], F.array(placed)).alias("out"), (s["ref"] + on_ref).alias("ref"), (s["read"] + on_read).alias("read"))

    return F.aggregate(cigar_ops(cigar), start, step, lambda s: s["out"])


def observations(reads: DataFrame) -> DataFrame:
    """One row per observed base or deletion: read columns, major, minor, symbol (``*``: deletion), quality.

    Insertions sit at the reference base before them with minor 1, 2, ...; a leading insertion has no such base and is left out, as are clips and skips.
    """
    ops = reads.withColumn("_op", F.explode(placed_ops(F.col("cigar"), F.col("pos")))).where(F.col("_op.op").isin("M", "=", "X", "D", "I"))
    each = ops.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_op.n") - 1)))
    inserted = F.col("_op.op") == "I"
    deleted = F.col("_op.op") == "D"
    at = F.col("_op.read") + F.col("_k")
    rows = each.select(
        *[c for c in reads.columns if c not in ("seq", "qual", "cigar", "pos")],
        F.when(inserted, F.col("_op.ref") - 1).otherwise(F.col("_op.ref") + F.col("_k")).alias("major"),
        F.when(inserted, F.col("_k") + 1).otherwise(0).cast("long").alias("minor"),
        F.when(deleted, "*").otherwise(F.upper(F.substr("seq", at + 1, F.lit(1)))).alias("symbol"),
        F.when(~deleted, F.get("qual", at)).alias("quality"),
        F.col("pos").alias("_pos"),
    )
    return rows.where(F.col("major") >= F.col("_pos")).drop("_pos")


def read_slice(reads: DataFrame, start: Column, end: Column) -> DataFrame:
    """Reads cut to the reference window [start, end): qname, seq of the bases aligned in it, insertions after its last base left out."""
    seen = observations(reads.withColumn("_from", start).withColumn("_to", end))
    inside = seen.where((F.col("major") >= F.col("_from")) & (F.col("major") < F.col("_to")) & (F.col("symbol") != "*"))
    parts = F.array_sort(F.collect_list(F.struct("major", "minor", "symbol")))
    return inside.groupBy("qname", "ref_name").agg(F.array_join(F.transform(parts, lambda p: p["symbol"]), "").alias("seq"))
