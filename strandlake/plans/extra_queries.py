"""Seeded sampling, checked edits and array queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import read_matrix, sampling, tandem, variants
from .registry import OBS_SQL, observations, query, table

_SHARE_SQL = "('0x' || substr(md5('3:' || doc_id), 1, 8))::BIGINT / 4294967296.0"


@query("mod5_seeded_split", f"SELECT doc_id, {_SHARE_SQL} < 0.2 AS is_valid FROM labels")
def mod5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(table(spark, sf_dir, "labels"), "doc_id", 0.2, 3).select("doc_id", "is_valid")


@query("srt10_seeded_shuffle", f"SELECT doc_id FROM labels ORDER BY {_SHARE_SQL}, doc_id LIMIT 50")
def srt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_shuffled(table(spark, sf_dir, "labels"), "doc_id", 50, 3).select("doc_id")


@query(
    "str18_apply_checked",
    """SELECT item_id, md5(substr(text, 1, 5) || 'XY' || substr(text, 8, 12) || substr(text, 24)) AS seq_md5, 1 AS substituted, 0 AS inserted, 1 AS deleted, 2 AS skipped FROM benchmark""",
)
def str18(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda pos, n: F.substr("text", F.lit(pos + 1), F.lit(n))
    edit = lambda pos, ref, alt: F.struct(F.lit(pos).cast("long").alias("pos"), ref.alias("ref"), F.lit(alt).alias("alt"))
    edits = F.array(edit(5, cut(5, 2), "XY"), edit(6, cut(6, 3), "Z"), edit(10, F.lit("@@@@"), "Q"), edit(19, cut(19, 4), ""))
    rows = table(spark, sf_dir, "benchmark").select("item_id", S.apply_checked(F.col("text"), edits).alias("a"))
    return rows.select("item_id", F.md5("a.seq").alias("seq_md5"), "a.substituted", "a.inserted", "a.deleted", "a.skipped")


@query("flt14_sex_regions", "SELECT c_custkey FROM customer WHERE NOT (c_nationkey % 3 = 1 AND c_custkey % 2 = 1)")
def flt14(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.when(F.col("c_nationkey") % 3 == 1, "Y").otherwise("1")
    sex = F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female")
    return table(spark, sf_dir, "customer").where(tandem.ploidy(ref, sex, F.lit(False)) > 0).select("c_custkey")


@query("flt12_ambiguous_reference_flt23", "SELECT p_partkey FROM part WHERE NOT contains(upper(p_name), 'N')")
def flt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(~F.contains(F.upper("p_name"), F.lit("N"))).select("p_partkey")


@query("str10_fixed_decimals", "SELECT p_partkey, printf('%.3f', p_retailprice) AS text FROM part")
def str10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.format_string("%.3f", F.col("p_retailprice")).alias("text"))


@query("var12_hetero_spans_win13", """WITH p AS (SELECT DISTINCT l_suppkey AS chrom, l_partkey AS pos FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT *, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS nxt FROM p),
    g AS (SELECT chrom, nxt - pos AS n FROM a WHERE nxt - pos >= 5) SELECT chrom, count(*)::BIGINT AS n_gaps, sum(n)::BIGINT AS homozygous, max(n)::BIGINT AS longest FROM g GROUP BY chrom""")
def var12(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("pos"))
    size = F.col("end") - F.col("start")
    return variants.homozygous_gaps(sites, 5).groupBy("chrom").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum(size).alias("homozygous"), F.max(size).alias("longest"))


@query("var12_zygosity_regions", """WITH p AS (SELECT DISTINCT l_suppkey AS chrom, unnest(range(l_partkey, l_partkey + l_linenumber)) AS pos FROM lineitem WHERE l_returnflag = 'R'),
    s AS (SELECT chrom, pos FROM p WHERE pos >= 100 AND pos < 1900 UNION SELECT DISTINCT l_suppkey, unnest([100, 1900]) FROM lineitem),
    a AS (SELECT chrom, pos AS first, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS next FROM s), g AS (SELECT chrom, first, next FROM a WHERE next - first >= 5),
    b AS (SELECT chrom, 100 AS first FROM (SELECT DISTINCT chrom FROM s) UNION ALL SELECT chrom, next FROM g), e AS (SELECT chrom, first AS stop FROM g UNION ALL SELECT DISTINCT chrom, 1900 FROM s),
    h AS (SELECT chrom, first, (SELECT min(stop) FROM e WHERE e.chrom = b.chrom AND e.stop >= b.first) AS next FROM b)
    SELECT chrom, 'homozygous' AS kind, first::BIGINT AS "start", next::BIGINT AS "end" FROM g UNION ALL SELECT chrom, 'heterozygous', first::BIGINT, next::BIGINT FROM h WHERE next - first > 5""")
def var12_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    mixed = lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("pos"), F.repeat(F.lit("N"), F.col("l_linenumber").cast("int")).alias("ref"))
    regions = lines.select(F.col("l_suppkey").alias("chrom"), F.lit(100).cast("long").alias("start"), F.lit(1900).cast("long").alias("end"))
    return variants.zygosity_regions(mixed, regions, 5, 1000).select("chrom", "kind", "start", "end")


def order_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reads of their customer, 30 to 119 days long."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("ref_name"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("qname"), day.alias("start"), (day + 30 + F.col("o_orderkey") % 90).alias("end")
    )


@query("rmx1_read_slots")
def rmx1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reads of a customer: matrix row of each, by the greedy rule. No SQL: a greedy order."""
    return read_matrix.assign_rows(order_reads(spark, sf_dir), block=1000)


@query("jn10_carried_rows_win6")
def jn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reads in blocks of 50 days, each with one row of its customer's matrix over all its blocks. No SQL: a greedy order."""
    return read_matrix.carry_rows(read_matrix.assign_rows(order_reads(spark, sf_dir), block=50))


@query(
    "rmx2_read_cells",
    f"""WITH {OBS_SQL} SELECT event_id, list_position(['A', 'C', 'G', 'T', '*'], symbol)::INT AS base, CASE WHEN is_rev THEN -1 ELSE 1 END AS strand, least(mapq, 127) AS mapq FROM obs""",
)
def rmx2(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("qname", F.col("event_id")).withColumn("ref_name", F.col("ref_name").cast("string"))
    rows = obs.select("ref_name", F.floor(F.col("major") / 100_000).alias("block"), "qname", F.col("event_id").alias("row"))
    cells = read_matrix.matrix(obs, rows)
    return cells.select(F.col("row").alias("event_id"), F.col("base").cast("int").alias("base"), F.col("strand").cast("int").alias("strand"), F.col("mapq").cast("int").alias("mapq"))


@query(
    "tdm8_replacement_variants",
    """WITH a AS (SELECT l_orderkey AS k, count(*)::BIGINT AS depth, min(l_quantity) AS low, max(l_quantity) AS high, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1)
    SELECT k, depth, low || '-' || high AS allele_range, median FROM a""",
)
def tdm8(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = tandem.length_spread(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity")
    text = F.concat_ws("-", F.col("low").cast("string"), F.col("high").cast("string"))
    return spread.select(F.col("l_orderkey").alias("k"), F.col("n").alias("depth"), text.alias("allele_range"), "median")


@query("jn19_supporting_reads", "SELECT o_orderkey, count(l_orderkey)::BIGINT AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def jn19(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "orders").join(reads, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("arr9_differences", "WITH e AS (SELECT user_id, event_id, floor(value)::BIGINT AS v FROM events) SELECT event_id, v - lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS diff FROM e")
def arr9(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor("value")
    return table(spark, sf_dir, "events").select("event_id", (v - F.lag(v).over(W.partitionBy("user_id").orderBy("event_id"))).alias("diff"))
