"""Interval, join and set queries: orders are intervals of days on their customer, events points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import natural_key
from ..operators import intervals, tandem
from .registry import OBS_SQL, ORDERS_SQL, observations, query, spans, table

KEY = ["ref_name"]
WIDTH = 64


@query(
    "jn1_overlap",
    f"""WITH {ORDERS_SQL} SELECT a.ref_name, a.id AS a_id, b.id AS b_id, least(a."end", b."end") - greatest(a."start", b."start") AS n
    FROM spans a JOIN spans b ON a.ref_name = b.ref_name AND a."start" < b."end" AND a."end" > b."start" AND a.id < b.id""",
)
def jn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    pairs = intervals.overlap_join(rows, rows, KEY, WIDTH).where("a_id < b_id")
    return pairs.select(F.col("a_ref_name").alias("ref_name"), "a_id", "b_id", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("n"))


@query(
    "jn2_overlap_semi",
    f"""WITH {ORDERS_SQL} SELECT ref_name, id FROM spans a WHERE EXISTS (SELECT 1 FROM spans b WHERE a.ref_name = b.ref_name AND a."start" < b."end" AND a."end" > b."start" AND b.id % 10 = 3)""",
)
def jn2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    return intervals.overlap_semi(rows, rows.where("id % 10 = 3"), KEY, WIDTH).select("ref_name", "id")


_POINTS_SQL = "pts AS (SELECT event_id, user_id AS ref_name, floor(value)::BIGINT * 30 AS pos FROM events)"


@query(
    "jn3_points_in",
    f"""WITH {ORDERS_SQL}, {_POINTS_SQL} SELECT event_id, id FROM pts JOIN spans ON pts.ref_name = spans.ref_name AND pos >= "start" AND pos < "end" """,
)
def jn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("ref_name"), (F.floor("value") * 30).alias("pos"))
    return intervals.points_in(points, spans(spark, sf_dir), KEY, "pos", WIDTH).select(F.col("p_event_id").alias("event_id"), F.col("i_id").alias("id"))


@query(
    "jn4_contained",
    f"""WITH {ORDERS_SQL} SELECT a.ref_name, a.id AS a_id, b.id AS b_id FROM spans a JOIN spans b ON a.ref_name = b.ref_name AND b."start" >= a."start" AND b."end" <= a."end" AND a.id <> b.id""",
)
def jn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    pairs = intervals.overlap_join(rows, rows, KEY, WIDTH, how="contain").where("a_id <> b_id")
    return pairs.select(F.col("a_ref_name").alias("ref_name"), "a_id", "b_id")


@query(
    "jn5_best_overlap",
    f"""WITH {ORDERS_SQL}, p AS (SELECT a.ref_name, a.id AS a_id, b.id AS b_id, greatest(a."start", b."start") AS s, least(a."end", b."end") AS e
        FROM spans a JOIN spans b ON a.ref_name = b.ref_name AND a."start" < b."end" AND a."end" > b."start" AND a.id % 2 = 0 AND b.id % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY ref_name, a_id ORDER BY e - s DESC, b_id) AS place FROM p)
    SELECT ref_name, a_id, b_id, s AS "start", e AS "end" FROM r WHERE place = 1""",
)
def jn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    return intervals.best_overlap(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), KEY, "id", WIDTH)


@query(
    "jn6_arbitrate",
    f"""WITH {ORDERS_SQL}, s AS (SELECT *, "end" - "start" AS size FROM spans),
    p AS (SELECT a.id AS x, b.id AS y, a."start" AS xs, b."start" AS ys, greatest(a."start", b."start") AS low, least(a."end", b."end") AS high,
        greatest(a.size, b.size) / least(a.size, b.size) < 2 AS alike, (least(a."end", b."end") - greatest(a."start", b."start")) / least(a.size, b.size) >= 0.5 AS much, a.size <= b.size AS xshort
        FROM s a JOIN s b ON a.ref_name = b.ref_name AND a."start" < b."end" AND a."end" > b."start" AND (a."start" < b."start" OR (a."start" = b."start" AND a.id < b.id))),
    j AS (SELECT x AS id, xs, x AS xi, ys, y AS yi, CASE WHEN alike AND NOT much THEN low END AS e, NULL::BIGINT AS b, much AND (alike OR xshort) AS gone FROM p
        UNION ALL SELECT y, xs, x, ys, y, NULL, CASE WHEN NOT much THEN high END, much AND (alike OR NOT xshort) FROM p),
    v AS (SELECT id, bool_or(gone) AS gone, arg_max(e, (xs, xi, ys, yi)) FILTER (WHERE e IS NOT NULL) AS e, arg_max(b, (xs, xi, ys, yi)) FILTER (WHERE b IS NOT NULL) AS b FROM j GROUP BY id)
    SELECT s.ref_name, s.id, coalesce(v.b, s."start") AS "start", coalesce(v.e, s."end") AS "end" FROM s LEFT JOIN v USING (id)
    WHERE NOT coalesce(gone, false) AND coalesce(v.e, s."end") - coalesce(v.b, s."start") >= 20""",
)
def jn6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.arbitrate(spans(spark, sf_dir), KEY, "id", least=20, width=WIDTH).select("ref_name", "id", "start", "end")


_MERGE_SQL = f"""{ORDERS_SQL}, m1 AS (SELECT *, max("end") OVER (PARTITION BY ref_name ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
    m2 AS (SELECT *, sum(coalesce("start" > reach, true)::INT) OVER (PARTITION BY ref_name ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m1),
    merged AS (SELECT ref_name, min("start") AS s, max("end") AS e, count(*)::BIGINT AS n FROM m2 GROUP BY ref_name, island)"""


@query("ivl4_merge", f'WITH {_MERGE_SQL} SELECT ref_name, s AS "start", e AS "end", n FROM merged')
def ivl4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(spans(spark, sf_dir), KEY)


@query("ivl4_merge_strict", f'WITH {_MERGE_SQL.replace("""start" > reach""", """start" >= reach""")} SELECT ref_name, s AS "start", e AS "end", n FROM merged')
def ivl4_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(spans(spark, sf_dir), KEY, touching=False)


@query("agg21_bases_covered", f"WITH {_MERGE_SQL} SELECT ref_name, sum(e - s)::BIGINT AS covered, round(sum(e - s) / 4000, 6) AS share FROM merged GROUP BY ref_name")
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge(spans(spark, sf_dir), KEY).groupBy("ref_name").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return merged.withColumn("share", F.round(F.col("covered") / 4000, 6))


@query(
    "ivl3_complement",
    f"""WITH {_MERGE_SQL}, c AS (SELECT ref_name, greatest(s, 0) AS s, least(e, 4000) AS e FROM merged WHERE s < 4000 AND e > 0),
    u AS (SELECT * FROM c UNION ALL SELECT c_custkey, 0, 0 FROM customer UNION ALL SELECT c_custkey, 4000, 4000 FROM customer),
    g AS (SELECT *, max(e) OVER (PARTITION BY ref_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM u)
    SELECT ref_name, f AS "start", s AS "end" FROM g WHERE f < s""",
)
def ivl3(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref_name"), F.lit(4000).alias("length"))
    return intervals.complement(spans(spark, sf_dir), lengths, KEY)


@query(
    "ivl8_overlap_warnings",
    f"""WITH {ORDERS_SQL}, m AS (SELECT *, max("end") OVER (PARTITION BY ref_name ORDER BY "start", "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)
    SELECT ref_name, id FROM m WHERE "start" < reach""",
)
def ivl8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("ref_name").orderBy("start", "end", "id").rowsBetween(W.unboundedPreceding, -1)
    return spans(spark, sf_dir).withColumn("reach", F.max("end").over(w)).where("start < reach").select("ref_name", "id")


@query("ivl7_padding", f'WITH {ORDERS_SQL} SELECT id, greatest(0, "start" - 10) AS "start", least(3500, "end" + 10) AS "end" FROM spans')
def ivl7(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = intervals.clamp(F.col("start"), F.col("end"), 10, F.lit(3500))
    return spans(spark, sf_dir).select("id", start.cast("long").alias("start"), end.cast("long").alias("end"))


@query(
    "win3_region_split",
    f"""WITH {ORDERS_SQL}, p AS (SELECT id, "start" AS a, "end" AS z, unnest(range("start", "end", 30)) AS s FROM spans),
    k AS (SELECT id, s, least(s + 40, z) AS e, a, z FROM p WHERE s + 40 <= z OR s = a),
    l AS (SELECT id, max(e) AS reach, any_value(z) AS z, any_value(a) AS a FROM k GROUP BY id)
    SELECT id, s AS "start", e AS "end" FROM k UNION ALL SELECT id, greatest(a, z - 40), z FROM l WHERE reach < z""",
)
def win3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.split_regions(spans(spark, sf_dir).select("id", "start", "end"), 40, 10)


@query(
    "set1_common",
    "SELECT o_custkey AS ref_name FROM orders INTERSECT SELECT user_id FROM events INTERSECT SELECT c_custkey FROM customer",
)
def set1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ref_name"))
    return orders.intersect(table(spark, sf_dir, "events").select("user_id")).intersect(table(spark, sf_dir, "customer").select("c_custkey"))


@query("set2_missing", "SELECT c_custkey AS ref_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set2(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(have, "c_custkey", "left_anti").select(F.col("c_custkey").alias("ref_name"))


@query("set5_distinct_variants", "SELECT DISTINCT l_returnflag AS ref, l_linestatus AS alt, l_partkey % 50 AS pos FROM lineitem")
def set5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"), (F.col("l_partkey") % 50).alias("pos"))
    return rows.dropDuplicates(["pos", "ref", "alt"])


@query(
    "set6_type_difference",
    "(SELECT 'orders' AS side, user_id AS id FROM events EXCEPT SELECT 'orders', o_custkey FROM orders) UNION ALL (SELECT 'events' AS side, o_custkey FROM orders EXCEPT SELECT 'events', user_id FROM events)",
)
def set6(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    lacking = users.subtract(buyers).select(F.lit("orders").alias("side"), "id")
    return lacking.unionByName(buyers.subtract(users).select(F.lit("events").alias("side"), "id"))


@query("srt1_natural_sort", "SELECT c_name AS name, c_custkey, row_number() OVER (ORDER BY c_custkey)::BIGINT AS place FROM customer")
def srt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("chr"), F.col("c_custkey").cast("string")).alias("short"), F.col("c_name").alias("name"), "c_custkey")
    ordered = rows.select("name", "c_custkey", natural_key(F.col("short")).alias("key"))
    before = ordered.groupBy(F.substring("key", 1, 18).alias("head")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    offset = F.sum("n").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1))
    offsets = before.withColumn("offset", F.coalesce(offset, F.lit(0)))
    inside = F.row_number().over(W.partitionBy("head").orderBy("key"))
    ranked = ordered.withColumn("head", F.substring("key", 1, 18)).withColumn("r", inside).join(offsets, "head")
    return ranked.select("name", "c_custkey", (F.col("offset") + F.col("r")).alias("place"))


@query(
    "srt9_read_cap",
    f"WITH {OBS_SQL}, r AS (SELECT event_id, ref_name, major, row_number() OVER (PARTITION BY ref_name, major ORDER BY ts, event_id) AS place FROM obs) SELECT event_id FROM r WHERE place <= 2",
)
def srt9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("ref_name", "major").orderBy("ts", "event_id"))
    return observations(spark, sf_dir).withColumn("place", place).where("place <= 2").select("event_id")


@query(
    "agg11_deep_molecules",
    "SELECT l_orderkey, count(*)::BIGINT AS n, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3 AND quantile_cont(l_quantity, 0.5) > 20",
)
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.deep_molecules(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", 3, 20)


@query(
    "agg13_length_spread_mth5",
    """WITH s AS (SELECT l_suppkey, count(*)::BIGINT AS n, min(l_quantity) AS low, max(l_quantity) AS high, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1)
    SELECT s.*, m.mad FROM s JOIN (SELECT l_suppkey, quantile_cont(abs(l_quantity - median), 0.5) AS mad FROM lineitem JOIN s USING (l_suppkey) GROUP BY 1) m USING (l_suppkey)""",
)
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.length_spread(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@query(
    "flt16_iqr_outliers",
    """WITH s AS (SELECT l_orderkey, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN s USING (l_orderkey) WHERE n <= 5 OR (l_extendedprice >= q1 - (q3 - q1) * 0.5 AND l_extendedprice <= q3 + (q3 - q1) * 0.5)""",
)
def flt16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return tandem.without_outliers(rows, ["l_orderkey"], "l_extendedprice", 0.5)


@query(
    "flt17_dominant_mode",
    """WITH n AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag),
    c AS (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS place FROM n)
    SELECT l_orderkey, l_linenumber FROM lineitem JOIN c USING (l_suppkey, l_returnflag) WHERE place = 1""",
)
def flt17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.dominant(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag").select("l_orderkey", "l_linenumber")


@query(
    "flt15_route_regions",
    """SELECT l_orderkey, count(*)::BIGINT AS n, max(l_quantity) AS longest, CASE WHEN count(*) < 3 THEN 'few_reads' WHEN max(l_quantity) > 45 THEN 'too_long' ELSE 'ok' END AS route FROM lineitem GROUP BY 1""",
)
def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.route_regions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", 3, 45)


_HAP_SQL = "haps AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS hap, l_linestatus = 'O' AS is_rev FROM lineitem)"


def haplotyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    hap = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(0)
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", hap.alias("hap"), (F.col("l_linestatus") == "O").alias("is_rev"))


@query(
    "agg12_strand_counts",
    f"WITH {_HAP_SQL} SELECT l_suppkey, "
    + ", ".join(f"count(*) FILTER (WHERE hap = {h} AND {c})::BIGINT AS hap{h}_{n}" for h in range(3) for c, n in (("NOT is_rev", "fwd"), ("is_rev", "rev"), ("true", "n")))
    + " FROM haps GROUP BY 1",
)
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.strand_counts(haplotyped(spark, sf_dir), ["l_suppkey"])


@query(
    "agg23_cluster_table_jn18",
    f"""WITH {_HAP_SQL}, t AS (SELECT l_suppkey, {", ".join(f"count(*) FILTER (WHERE l_linenumber % 2 + 1 = {c} AND hap = {h})::BIGINT AS c{c}h{h}" for c in (1, 2) for h in (1, 2))} FROM haps GROUP BY 1)
    SELECT *, c1h2 + c2h1 > c1h1 + c2h2 AS flipped FROM t""",
)
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.cluster_table(haplotyped(spark, sf_dir).withColumn("cluster", F.col("l_linenumber") % 2 + 1), ["l_suppkey"])


@query(
    "tdm5_hybrid",
    f"""WITH {_HAP_SQL}, g AS (SELECT l_orderkey FROM haps GROUP BY 1 HAVING least(count(*) FILTER (WHERE hap = 1), count(*) FILTER (WHERE hap = 2)) >= 1)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey IN (SELECT l_orderkey FROM g) THEN hap ELSE 1 + l_linenumber % 2 END::INT AS hap FROM haps""",
)
def tdm5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = haplotyped(spark, sf_dir).select("l_orderkey", "l_linenumber", "hap")
    return tandem.hybrid(rows, rows.withColumn("hap", 1 + F.col("l_linenumber") % 2), ["l_orderkey"], 1)


@query(
    "tdm4_two_clusters",
    f"""WITH {_HAP_SQL}, r AS (SELECT *, l_quantity - lag(l_quantity) OVER w AS gap, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM haps WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity)),
    c AS (SELECT l_orderkey, arg_max(l_quantity, (gap, l_quantity)) AS cut FROM r WHERE gap > 0 AND k >= 0.3 * n AND n - k >= 0.3 * n GROUP BY 1)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= cut THEN 2 ELSE 1 END AS cluster FROM haps LEFT JOIN c USING (l_orderkey)""",
)
def tdm4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.two_clusters(haplotyped(spark, sf_dir), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "cluster")


@query(
    "tdm1_ploidy",
    """SELECT c_custkey, CASE WHEN r = 'Y' AND sex = 'female' THEN 0 WHEN r IN ('X', 'Y') AND sex = 'male' AND NOT par THEN 1 ELSE 2 END AS ploidy
    FROM (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE '1' END AS r, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, c_acctbal < 0 AS par FROM customer)""",
)
def tdm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.when(F.col("c_nationkey") % 3 == 0, "X").when(F.col("c_nationkey") % 3 == 1, "Y").otherwise("1")
    sex = F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female")
    return table(spark, sf_dir, "customer").select("c_custkey", tandem.ploidy(ref, sex, F.col("c_acctbal") < 0).alias("ploidy"))


@query(
    "tdm7_genotype",
    """WITH a AS (SELECT p_partkey, substr(p_type, 1, 1) AS ref, substr(p_name, 1, 1) AS a1, CASE WHEN p_size % 7 = 0 THEN NULL ELSE upper(substr(p_name, 1, 1)) END AS a2 FROM part),
    b AS (SELECT *, list_filter(CASE WHEN a1 = a2 THEN [a1] ELSE [a1, a2] END, lambda x: x IS NOT NULL AND x != ref) AS alts FROM a)
    SELECT p_partkey, CASE WHEN a1 = ref THEN '0' ELSE list_position(alts, a1)::VARCHAR END || '|' || CASE WHEN a2 IS NULL THEN '.' WHEN a2 = ref THEN '0' ELSE list_position(alts, a2)::VARCHAR END AS gt, array_to_string(alts, ',') AS alt FROM b""",
)
def tdm7(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("p_name", 1, 1)
    second = F.when(F.col("p_size") % 7 != 0, F.upper(first))
    call = tandem.genotype(F.substring("p_type", 1, 1), F.array(first, second))
    return table(spark, sf_dir, "part").select("p_partkey", call["gt"].alias("gt"), F.array_join(call["alt"], ",").alias("alt"))
