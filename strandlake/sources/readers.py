"""Readers of text formats as DataFrames: SAM, FASTA, FASTQ, BED, VCF and key-value TSV. Files are split and read by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import string_to_info


def _null(text: Column) -> Column:
    return F.when(~text.isin(".", "*", ""), text)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments; pos is 0-based, qual an array of numbers, tags a map from name to text."""
    f = lambda k: F.get("f", F.lit(k))
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    tags = F.transform(F.slice("f", 12, 10_000), lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)), F.regexp_extract(t, "^..:.:(.*)$", 1)))
    quals = F.transform(F.split(f(10), ""), lambda c: F.ascii(c) - 33)
    return rows.select(
        f(0).alias("qname"),
        f(1).cast("int").alias("flag"),
        _null(f(2)).alias("ref_name"),
        (f(3).cast("long") - 1).alias("pos"),
        f(4).cast("int").alias("mapq"),
        _null(f(5)).alias("cigar"),
        _null(f(9)).alias("seq"),
        F.when(~f(10).isin("*", ""), quals).alias("qual"),
        F.map_from_entries(tags).alias("tags"),
    )


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """kind and a map of tags for each header line."""
    rows = spark.read.text(path).where(F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"))
    pairs = F.transform(F.slice("f", 2, 1000), lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)), F.substr(t, F.lit(4), F.length(t))))
    return rows.select(F.substr(F.get("f", F.lit(0)), F.lit(2), F.lit(2)).alias("kind"), F.map_from_entries(pairs).alias("tags"))


def contigs(header: DataFrame) -> DataFrame:
    """ref_name, length."""
    return header.where("kind = 'SQ'").select(F.col("tags")["SN"].alias("ref_name"), F.col("tags")["LN"].cast("long").alias("length"))


def read_groups(header: DataFrame) -> DataFrame:
    return header.where("kind = 'RG'").select(F.col("tags")["ID"].alias("read_group"), F.col("tags")["DS"].alias("description"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq, length. A record is read as one row, cut at its ``>``."""
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "")
    body = F.regexp_replace(F.regexp_replace("value", "^[^\n]*(\n|$)", ""), r"\s", "")
    return rows.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.regexp_extract(head, r"^\S+\s+(.*)$", 1).alias("comment"), body.alias("seq")).withColumn(
        "length", F.length("seq").cast("long")
    )


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq, qual of four-line records. Files are split at lines that begin with ``@``.

    Qualities may begin with ``@`` too; such a record comes in two pieces, which are put together by their order in the file.
    """
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    pieces = spark.read.option("lineSep", "\n@").text(path).select("value", *place)
    pieces = pieces.select(F.split(F.regexp_replace(F.regexp_replace("value", r"\n$", ""), "^@", ""), "\n").alias("lines"), "file", "block", "n")
    line = lambda k: F.get("lines", F.lit(k))
    whole = pieces.where(F.size("lines") == 4).select(line(0).alias("head"), line(1).alias("seq"), line(3).alias("qual"))
    w = W.partitionBy("file").orderBy("block", "n")
    torn = pieces.where(F.size("lines") < 4).withColumn("_rest", F.lead(line(0)).over(w)).where(F.size("lines") == 3)
    torn = torn.select(line(0).alias("head"), line(1).alias("seq"), F.concat(F.lit("@"), "_rest").alias("qual"))
    return whole.unionByName(torn).select(
        F.regexp_extract("head", r"^(\S+)", 1).alias("name"), F.regexp_extract("head", r"^\S+\s+(.*)$", 1).alias("comment"), "seq", "qual"
    )


def bed(spark: SparkSession, path: str) -> DataFrame:
    """ref_name, start, end; browser, track and short lines are skipped."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    rows = rows.where((F.size("f") >= 3) & ~F.get("f", F.lit(0)).isin("browser", "track") & ~F.get("f", F.lit(0)).startswith("#"))
    return rows.select(F.get("f", F.lit(0)).alias("ref_name"), F.get("f", F.lit(1)).cast("long").alias("start"), F.get("f", F.lit(2)).cast("long").alias("end"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variant records of one sample; pos is 0-based, ref upper case, genotype an ordered array of pairs."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    f = lambda k: F.get("f", F.lit(k))
    calls = F.zip_with(F.split(f(8), ":"), F.split(f(9), ":"), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    return rows.select(
        f(0).alias("chrom"),
        (f(1).cast("long") - 1).alias("pos"),
        f(2).alias("id"),
        F.upper(f(3)).alias("ref"),
        F.split(f(4), ",").alias("alt"),
        f(5).try_cast("double").alias("qual"),
        F.split(f(6), ";").alias("filter"),
        string_to_info(f(7)).alias("info"),
        F.when(F.size("f") > 9, calls).alias("genotype"),
    )


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """kind, id, number, type, description of INFO, FILTER and FORMAT lines."""
    rows = spark.read.text(path).where(F.col("value").startswith("##"))
    take = lambda k: F.nullif(F.regexp_extract("value", k + r"=([^,>\"]+|\"[^\"]*\")", 1), F.lit(""))
    rows = rows.withColumn("kind", F.regexp_extract("value", "^##(INFO|FILTER|FORMAT)=<", 1)).where("kind != ''")
    return rows.select("kind", take("ID").alias("id"), take("Number").alias("number"), take("Type").alias("type"), F.trim(take("Description"), F.lit('"')).alias("description"))


def unsorted_records(variants: DataFrame, order: str) -> DataFrame:
    """Records that stand before their predecessor within a chromosome; ``order`` is the column of their place in the file."""
    w = W.partitionBy("chrom").orderBy(order)
    return variants.withColumn("_before", F.lag("pos").over(w)).where(F.col("pos") < F.col("_before")).drop("_before")


def fetch(variants: DataFrame, chrom: str, start: int | None = None, end: int | None = None, mode: str = "overlap") -> DataFrame:
    """Records on ``chrom`` that overlap, or are contained in, [start, end)."""
    stop = F.col("pos") + F.length("ref")
    rows = variants.where(F.col("chrom") == chrom)
    if mode == "overlap":
        low, high = stop > (start if start is not None else -1), F.col("pos") < (end if end is not None else 2**62)
    elif mode == "contained":
        low, high = F.col("pos") >= (start or 0), stop <= (end if end is not None else 2**62)
    else:
        raise ValueError(f"mode is overlap or contained, not {mode!r}")
    return rows.where(low & high)


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a two-column TSV."""
    return spark.read.csv(path, sep="\t", schema="key string, value string")


def chunk_store(spark: SparkSession, path: str, regions: DataFrame | None = None, width: int = 10_000) -> DataFrame:
    """Columns written by ``writers.chunk_store``; with ``regions``, of chunks that overlap one."""
    from ..operators.intervals import overlap_semi

    columns = spark.read.parquet(path)
    if regions is None:
        return columns
    spans = columns.groupBy("ref_name", "sample_id").agg(F.min("major").alias("start"), (F.max("major") + 1).alias("end"))
    wanted = overlap_semi(spans, regions, ["ref_name"], width).select("ref_name", "sample_id")
    return columns.join(wanted, ["ref_name", "sample_id"], "left_semi")


def check_read_group(groups: DataFrame, wanted: str | None) -> None:
    """Several read groups need one to be named, and a named one must be there."""
    if wanted is None:
        if groups.select("read_group").distinct().limit(2).count() > 1:
            raise ValueError("there are several read groups: name one")
    elif groups.where(F.col("read_group") == wanted).isEmpty():
        raise ValueError(f"no read group {wanted!r}")


def basecallers(groups: DataFrame) -> DataFrame:
    """Distinct basecaller models named in read-group descriptions."""
    return groups.select(F.regexp_extract("description", r"basecall_model=(\S+)", 1).alias("model")).where("model <> ''").distinct()


def without_shorter_names(names: DataFrame, column: str = "model") -> DataFrame:
    """Names less those that are part of a longer one with a version (``@``)."""
    longer = names.where(F.contains(column, F.lit("@"))).select(F.col(column).alias("_longer"))
    part = (F.col("_longer") != F.col(column)) & F.contains("_longer", F.col(column)) & ~F.contains(column, F.lit("@"))
    return names.join(longer, part, "left_anti")


def has_tag(alignments: DataFrame, tag: str) -> bool:
    """Whether the first alignment carries a tag."""
    return not alignments.limit(1).where(F.map_contains_key("tags", F.lit(tag))).isEmpty()


def subreads(sequences: DataFrame, depth: int = 0, length: float = 0) -> DataFrame:
    """read_id, subread, seq of records named read_number, of molecules with at least ``depth`` sub-reads whose median length exceeds ``length``."""
    from ..operators.tandem import deep_molecules

    rows = sequences.select(F.regexp_extract("name", r"^(.*)_[^_]*$", 1).alias("read_id"), F.col("name").alias("subread"), "seq")
    good = deep_molecules(rows.withColumn("_n", F.length("seq")), ["read_id"], "_n", depth, length)
    return rows.join(good.select("read_id"), "read_id", "left_semi")


def file_reads(spark: SparkSession, path: str) -> DataFrame:
    """read_id, subread, seq: every FASTA file is one molecule, named by its path."""
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("read_id")).where(F.length(F.trim("value")) > 0)
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "")
    body = F.regexp_replace(F.regexp_replace("value", "^[^\n]*(\n|$)", ""), r"\s", "")
    return rows.select("read_id", F.regexp_extract(head, r"^(\S+)", 1).alias("subread"), body.alias("seq"))


def with_run_lengths(alignments: DataFrame, params: DataFrame) -> DataFrame:
    """Alignments with arrays shape and scale of a table (read_id, shape, scale); null for reads that are not in it."""
    known = params.select(F.col("read_id").alias("qname"), "shape", "scale")
    return alignments.join(known, "qname", "left")


def metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """What ``writers.metadata`` wrote."""
    return {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(path).collect()}
