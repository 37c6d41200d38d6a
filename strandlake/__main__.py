"""Commands: python -m strandlake COMMAND --help."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequences as S
from .operators import intervals, variants
from .plans import pipelines
from .session import session
from .sources import readers, writers


def _reference(spark: SparkSession, path: str) -> DataFrame:
    return readers.fasta(spark, path).select(F.col("name").alias("ref_name"), "seq")


def inference(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.chunk_store(pipelines.inference(readers.sam(spark, a.input), min_mapq=a.min_mapq), a.output)


def sequence(spark: SparkSession, a: argparse.Namespace) -> None:
    done = pipelines.sequence(readers.chunk_store(spark, a.input), _reference(spark, a.reference), a.fill, a.min_depth)
    writers.fasta(done.withColumnRenamed("ref_name", "name"), a.output)


def vcf(spark: SparkSession, a: argparse.Namespace) -> None:
    called = pipelines.call_variants(readers.chunk_store(spark, a.input), _reference(spark, a.reference), a.ambiguous)
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    rows = called.select(
        "chrom", "pos", F.lit(None).cast("string").alias("id"), "ref", F.array("alt").alias("alt"), "qual", F.array(F.lit("PASS")).alias("filter"), F.create_map().cast("map<string,string>").alias("info"),
        F.array(pair("GT", F.lit("1")), pair("GQ", F.round("qual").cast("int").cast("string"))).alias("genotype"),
    )
    writers.vcf(rows, a.output, ["##fileformat=VCFv4.1", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Quality">'])


def classify(spark: SparkSession, a: argparse.Namespace) -> None:
    records = readers.vcf(spark, a.input)
    kinds = variants.by_class_group(records.withColumn("kind", variants.classify(F.col("ref"), F.col("alt"))))
    lines = writers.vcf_lines(kinds.withColumn("id", F.concat_ws("\t", "class_group", F.coalesce("id", F.lit(".")))))
    writers.by_group(lines.select(F.regexp_extract("line", r"^[^\t]*\t\d+\t([^\t]*)\t", 1).alias("class_group"), F.regexp_replace("line", r"^([^\t]*\t\d+\t)[^\t]*\t", "$1").alias("value")), "class_group", a.output)


def annotate(spark: SparkSession, a: argparse.Namespace) -> None:
    done = pipelines.depth_of_records(readers.vcf(spark, a.input), readers.sam(spark, a.reads))
    tags = F.create_map(F.lit("DP"), F.col("dp").cast("string"), F.lit("DPS"), F.concat_ws(",", F.col("dp_fwd").cast("string"), F.col("dp_rev").cast("string")))
    writers.vcf(done.withColumn("info", F.map_concat(F.map_filter("info", lambda k, v: ~k.isin("DP", "DPS")), tags)), a.output, ["##fileformat=VCFv4.1"])


def vcf2tsv(spark: SparkSession, a: argparse.Namespace) -> None:
    keys = [r["id"] for r in readers.vcf_header(spark, a.input).where("kind = 'INFO'").select("id").distinct().collect()]
    variants.info_table(readers.vcf(spark, a.input), sorted(keys)).write.csv(a.output, sep="\t", header=True)


def chunks_to_bed(spark: SparkSession, a: argparse.Namespace) -> None:
    spans = readers.chunk_store(spark, a.input).groupBy("ref_name", "sample_id").agg(F.min("major").alias("start"), (F.max("major") + 1).alias("end"))
    writers.bed(intervals.merge(spans, ["ref_name"]), a.output)


def homozygous_regions(spark: SparkSession, a: argparse.Namespace) -> None:
    records = readers.vcf(spark, a.input).withColumn("gt", F.get("genotype", F.lit(0))["v"])
    mixed = records.where(F.size(F.array_distinct(F.split("gt", r"[/|]"))) > 1)
    gaps = variants.homozygous_gaps(mixed.select("chrom", "pos"), a.min_len)
    gaps.select(S.region_format(F.col("chrom"), F.col("start"), F.col("end"))).write.text(a.output)


def haploid2diploid(spark: SparkSession, a: argparse.Namespace) -> None:
    one, two = (readers.vcf(spark, p).select("chrom", "pos", "ref", F.get("alt", F.lit(0)).alias("alt"), "qual") for p in (a.input, a.other))
    merged = variants.merge_haplotypes(one, two, _reference(spark, a.reference).withColumnRenamed("ref_name", "chrom"))
    call = F.array(F.struct(F.lit("GT").alias("k"), F.col("gt").alias("v")))
    rows = merged.withColumns({"genotype": call, "id": F.lit(None).cast("string"), "filter": F.array(F.lit("PASS")), "info": F.create_map().cast("map<string,string>")})
    writers.vcf(rows, a.output, ["##fileformat=VCFv4.1"])


def fastrle(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.fastq(spark, a.input).select("name", S.compress_homopolymers(F.col("seq"), a.block).alias("c"))
    writers.fasta(rows.select("name", "c.seq", F.col("c.runs").alias("qual")), a.output, qualities=True)


def smolecule(spark: SparkSession, a: argparse.Namespace) -> None:
    done = pipelines.molecules(readers.subreads(readers.fasta(spark, a.input), a.depth, a.length), a.depth, a.length)
    writers.fasta(done.withColumnRenamed("read_id", "name"), a.output)


def tandem(spark: SparkSession, a: argparse.Namespace) -> None:
    done = pipelines.repeats(readers.sam(spark, a.input), readers.bed(spark, a.regions).distinct(), _reference(spark, a.reference), a.min_reads)
    done.withColumn("alt", F.array_join("alt", ",")).write.csv(a.output, sep="\t", header=True)


OPTIONS = {
    inference: {"min_mapq": 1},
    sequence: {"reference": str, "fill": None, "min_depth": None},
    vcf: {"reference": str, "ambiguous": False},
    classify: {},
    annotate: {"reads": str},
    vcf2tsv: {},
    chunks_to_bed: {},
    homozygous_regions: {"min_len": 1000},
    haploid2diploid: {"other": str, "reference": str},
    fastrle: {"block": 94},
    smolecule: {"depth": 3, "length": 0},
    tandem: {"regions": str, "reference": str, "min_reads": 3},
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandlake")
    commands = parser.add_subparsers(required=True)
    for command, options in OPTIONS.items():
        sub = commands.add_parser(command.__name__)
        sub.add_argument("input")
        sub.add_argument("output")
        for name, default in options.items():
            flag = f"--{name}"
            if default is str:
                sub.add_argument(flag, required=True)
            elif default is False:
                sub.add_argument(flag, action="store_true")
            elif name == "min_depth":
                sub.add_argument(flag, type=int)
            else:
                sub.add_argument(flag, default=default, type=type(default) if default is not None else str)
        sub.set_defaults(command=command)
    given = parser.parse_args(argv)
    given.command(session(), given)


if __name__ == "__main__":
    main()
