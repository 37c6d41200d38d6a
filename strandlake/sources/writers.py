"""Writers of text formats and of the chunk store. Each partition writes its own file; ask for one partition if one file is wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import info_to_string, natural_key


def fasta(df: DataFrame, path: str, qualities: bool = False) -> None:
    """Records of name, seq (and qual: FASTQ)."""
    fields = [F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual"] if qualities else [F.concat(F.lit(">"), "name"), "seq"]
    df.select(F.concat_ws("\n", *fields)).write.text(path)


def vcf_lines(df: DataFrame) -> DataFrame:
    """chrom, pos, line: records as text, POS 1-based."""
    pairs = F.coalesce("genotype", F.array().cast("array<struct<k:string,v:string>>"))
    kept: Column = F.size(pairs) > 0
    line = F.concat_ws(
        "\t",
        "chrom",
        (F.col("pos") + 1).cast("string"),
        F.coalesce("id", F.lit(".")),
        "ref",
        F.coalesce(F.nullif(F.array_join("alt", ","), F.lit("")), F.lit(".")),
        F.when(F.col("qual").isNull(), ".").otherwise(F.format_string("%.3f", F.col("qual"))),
        F.coalesce(F.nullif(F.array_join("filter", ";"), F.lit("")), F.lit(".")),
        info_to_string(F.col("info")),
        F.when(kept, F.array_join(F.transform(pairs, lambda p: p["k"]), ":")),
        F.when(kept, F.array_join(F.transform(pairs, lambda p: p["v"]), ":")),
    )
    return df.select("chrom", "pos", line.alias("line"))


def vcf(df: DataFrame, path: str, header: list[str], sample: str = "SAMPLE") -> None:
    """Header lines, INFO before FILTER before FORMAT, then records by natural order of chromosome and position.

    A global sort spreads records over files in order; the header is in a file of its own that comes first.
    """
    rank = {"##INFO": 1, "##FILTER": 2, "##FORMAT": 3}
    lines = sorted(header, key=lambda h: rank.get(h.split("=")[0], 0))
    lines.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample]))
    head = df.sparkSession.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    body = vcf_lines(df).orderBy(natural_key(F.col("chrom")), "pos").select("line")
    head.write.mode("append").text(f"{path}/header")
    body.write.mode("append").text(f"{path}/records")


def bed(df: DataFrame, path: str) -> None:
    df.orderBy(natural_key(F.col("ref_name")), "start", "end").select("ref_name", "start", "end").write.csv(path, sep="\t")


def sam(df: DataFrame, path: str) -> None:
    """Alignments as text, by reference and position."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit(":Z:"), e["value"])), "\t")
    quals = F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")
    star = lambda c: F.coalesce(c, F.lit("*"))
    fields = ["qname", F.col("flag").cast("string"), star(F.col("ref_name")), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), star(F.col("cigar"))]
    line = F.concat_ws("\t", *fields, F.lit("*"), F.lit("0"), F.lit("0"), star(F.col("seq")), star(quals), F.nullif(tags, F.lit("")))
    df.orderBy("ref_name", "pos").select(line).write.text(path)


def chunk_store(df: DataFrame, path: str) -> None:
    """Columns of chunks, each chunk name once, in a folder per reference."""
    df.dropDuplicates(["ref_name", "sample_id", "major", "minor"]).repartition("ref_name").sortWithinPartitions("sample_id", "major", "minor").write.partitionBy("ref_name").parquet(path)


def by_group(df: DataFrame, group: str, path: str) -> None:
    df.write.partitionBy(group).parquet(path)


def tagged_union(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Alignments of several sources, each with its own value of a tag put in."""
    tagged = [df.withColumn("tags", F.map_concat(F.map_filter("tags", lambda k, v: k != tag), F.create_map(F.lit(tag), F.lit(value)))) for value, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def concat_tsv(paths: list[str], df_of: DataFrame, path: str) -> None:
    """Several TSV files with one header as one table, written with one header a file. ``df_of`` gives the session and the columns."""
    df_of.sparkSession.read.schema(df_of.schema).csv(paths, sep="\t", header=True).write.csv(path, sep="\t", header=True)


def metadata(df_of: DataFrame, values: dict[str, str], path: str) -> None:
    """A few keys and values as JSON beside a store; later ones replace earlier ones."""
    df_of.sparkSession.createDataFrame(sorted(values.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(path)


def metrics(df: DataFrame, path: str, method: str = "phasing_method") -> None:
    """Metrics of regions as TSV, each file with a header, in a folder for each phasing method, by reference and start."""
    df.repartition(method).sortWithinPartitions(method, natural_key(F.col("ref_name")), "start", "end").write.partitionBy(method).csv(path, sep="\t", header=True)
