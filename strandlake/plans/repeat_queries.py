"""Queries of tandem repeats and polishing: customers have a sequence of 64 bases, their orders are reads of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tandem
from .polish import polish
from .registry import query, table

_TRUTH_SQL = """c AS (SELECT c_custkey AS k, translate(md5(c_custkey::VARCHAR) || md5('x' || c_custkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS t FROM customer)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, t: 64 bases of each customer."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.md5(key.cast("binary")), F.md5(F.concat(F.lit("x"), key).cast("binary")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.translate(text, "0123456789abcdef", "ACGTACGTACGTACGT").alias("t"))


def _part(start: int, size: int = 64) -> Column:
    return F.substring("t", start, size)


@query(
    "tdm6_allele_records_tdm8",
    f"""WITH {_TRUTH_SQL}, r AS (SELECT o_custkey AS k, 1 + o_orderkey % 2 AS hap, count(*) AS n, min(24 + o_orderkey % 7) AS low, max(24 + o_orderkey % 7) AS high, mad(24 + o_orderkey % 7) AS away FROM orders GROUP BY 1, 2),
    h AS (SELECT c.k, hap, n, low, high, away, substr(t, 21, 24) AS ref, CASE CASE WHEN hap = 1 THEN c.k % 4 ELSE c.k // 4 % 4 END WHEN 0 THEN substr(t, 21, 24)
        WHEN 1 THEN substr(t, 21, 10) || translate(substr(t, 31, 1), 'ACGT', 'TGCA') || substr(t, 32, 13) WHEN 2 THEN substr(t, 21, 5) || substr(t, 29, 16)
        ELSE substr(t, 21, 5) || 'CAG' || substr(t, 26, 19) END AS a FROM c JOIN r ON c.k = r.k),
    g AS (SELECT k, ref, max(a) FILTER (hap = 1) AS a1, max(a) FILTER (hap = 2) AS a2, string_agg(n::VARCHAR, ',' ORDER BY hap) AS sd, string_agg(low || '-' || high, ',' ORDER BY hap) AS allr,
        string_agg(printf('%.2f', away::DOUBLE), ',' ORDER BY hap) AS mad FROM h GROUP BY 1, 2),
    l AS (SELECT *, list_filter(CASE WHEN a1 = a2 THEN [a1] ELSE [a1, a2] END, lambda x: x IS NOT NULL AND x != ref) AS alts FROM g)
    SELECT 'c' || k AS chrom, 1020::BIGINT AS pos, 'c' || k || '_1020_1044' AS id, ref, array_to_string(alts, ',') AS alt,
        CASE WHEN a1 IS NULL THEN '.' WHEN a1 = ref THEN '0' ELSE list_position(alts, a1)::VARCHAR END || CASE WHEN k % 3 = 0 THEN '/' ELSE '|' END
        || CASE WHEN a2 IS NULL THEN '.' WHEN a2 = ref THEN '0' ELSE list_position(alts, a2)::VARCHAR END AS gt, sd, allr, mad, CASE WHEN k % 3 <> 0 THEN (k % 3)::VARCHAR END AS ps FROM l""",
)
def tdm6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the bases 20 to 44 of each customer: two haplotypes with a substitution, a deletion, an insertion or nothing; those without orders are not called."""
    region = [F.concat(F.lit("c"), F.col("k").cast("string")).alias("ref_name"), F.lit(1020).cast("long").alias("start"), F.lit(1044).cast("long").alias("end")]
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (1 + F.col("o_orderkey") % 2).cast("int").alias("hap"), F.col("o_orderkey").cast("string").alias("qname"), (24 + F.col("o_orderkey") % 7).alias("length"))
    kind = F.when(F.col("hap") == 1, F.col("k") % 4).otherwise(F.floor(F.col("k") / 4) % 4)
    seq = F.when(kind == 0, F.col("t")).when(kind == 1, F.concat(_part(1, 30), F.translate(_part(31, 1), "ACGT", "TGCA"), _part(32)))
    seq = seq.when(kind == 2, F.concat(_part(1, 25), _part(29))).otherwise(F.concat(_part(1, 25), F.lit("CAG"), _part(26)))
    cigar = F.when(kind == 0, "64=").when(kind == 1, "30=1X33=").when(kind == 2, "25=3D36=").otherwise("25=3I39=")
    rows = truth(spark, sf_dir).withColumn("hap", F.explode(F.array(F.lit(1), F.lit(2)))).join(orders.select("k", "hap").distinct(), ["k", "hap"], "left_semi")
    rows = rows.select(*region, "hap", (F.col("k") % 3).alias("phase_set"), seq.alias("seq"), cigar.alias("cigar"), _part(21, 24).alias("ref"))
    bounds = tandem.aligned_bounds(F.col("cigar"), F.lit(1000), F.col("start"), F.col("end"))
    alleles = rows.withColumn("allele", tandem.bounded_allele(F.col("seq"), bounds))
    found = tandem.replacement_records(alleles, orders.select(*region, "hap", "qname", "length"))
    of = lambda name: F.get(F.filter("genotype", lambda g: g["k"] == name), F.lit(0))["v"]
    return found.select("chrom", "pos", "id", "ref", F.array_join("alt", ",").alias("alt"), of("GT").alias("gt"), of("SD").alias("sd"), of("ALLR").alias("allr"), of("MAD").alias("mad"), of("PS").alias("ps"))


@query(
    "tdm10_polish",
    f"""WITH {_TRUTH_SQL}, o AS (SELECT o_custkey AS k, o_orderkey % 24 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    s AS (SELECT k, p, n, count(*) AS changed FROM o WHERE n >= 3 GROUP BY ALL),
    b AS (SELECT k, i, substr(t, i + 1, 1) AS own, translate(substr(t, i + 1, 1), 'ACGT', 'TGCA') AS other FROM c, range(0, 64) x(i) WHERE k IN (SELECT k FROM s))
    SELECT b.k, string_agg(CASE WHEN changed IS NULL OR 2 * changed < n THEN own WHEN 2 * changed > n THEN other ELSE least(own, other) END, '' ORDER BY i) AS seq FROM b LEFT JOIN s ON b.k = s.k AND b.i = s.p GROUP BY 1""",
)
def tdm10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that lack a base and have one too many, polished by reads with a base replaced each, of customers with three orders at least.

    Reads differ in the first 24 bases and drafts after the 29th: where half of the reads differ beside a base the draft lacks, they have
    several best alignments and their majority depends on which is taken, which SQL by position can't say.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"))
    deep = orders.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("k")
    rows = truth(spark, sf_dir).join(deep, "k", "left_semi").withColumn("d", 30 + F.col("k") % 20).withColumn("e", 52 + F.col("k") % 8)
    drafts = rows.select(F.col("k").cast("string").alias("name"), F.expr("concat(substr(t, 1, d - 1), substr(t, d + 1, e - d), 'G', substr(t, e + 1))").alias("seq"))
    changed = F.expr("concat(substr(t, 1, o % 24), translate(substr(t, o % 24 + 1, 1), 'ACGT', 'TGCA'), substr(t, o % 24 + 2))")
    reads = orders.join(rows.select("k", "t"), "k").select(F.col("k").cast("string").alias("name"), F.col("o").cast("string").alias("read"), changed.alias("seq"))
    kind = dict(orders.dtypes)["k"]
    return polish(drafts, reads).select(F.col("name").cast(kind).alias("k"), "seq")
