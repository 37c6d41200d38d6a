"""Records, reads and stitched chunks: line items are reads and tags, orders chunks, parts variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.sequences import phred_char
from ..operators import consensus, encoders, intervals, islands, labels, pileup, reads, tandem, variants
from ..sources import readers, writers
from .island_queries import order_chunks, order_samples, positions
from .pileup_queries import PILE_SQL, pile
from .registry import OBS_SQL, ORDERS_SQL, observations, query, spans, table

READ_SQL = """reads AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'c' || l_suppkey AS ref_name, (CASE l_partkey % 9 WHEN 0 THEN 4 WHEN 1 THEN 256 WHEN 2 THEN 2048 WHEN 3 THEN 16 ELSE 0 END)::INT AS flag,
    l_quantity::INT AS mapq, CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' END AS tag, l_linestatus AS rg, l_partkey % 3000 AS pos, l_quantity::INT AS n FROM lineitem)"""


def line_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alignments without sequence."""
    flags = F.when(F.col("l_partkey") % 9 == 0, 4).when(F.col("l_partkey") % 9 == 1, 256).when(F.col("l_partkey") % 9 == 2, 2048).when(F.col("l_partkey") % 9 == 3, 16).otherwise(0)
    tag = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "2")
    tags = F.map_filter(F.create_map(F.lit("AA"), tag, F.lit("RG"), F.col("l_linestatus")), lambda k, v: v.isNotNull())
    n = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("ref_name"), flags.alias("flag"), n.alias("mapq"),
        tags.alias("tags"), (F.col("l_partkey") % 3000).alias("pos"), n.alias("n"), F.concat(n.cast("string"), F.lit("=")).alias("cigar"),
    )


@query("flt1_primary_reads", f"WITH {READ_SQL} SELECT id, flag, mapq FROM reads WHERE flag NOT IN (4, 256, 2048) AND mapq >= 5")
def flt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.primary(line_reads(spark, sf_dir), 5).select("id", "flag", "mapq")


@query("flt3_tag_keep_missing", f"WITH {READ_SQL} SELECT id FROM reads WHERE tag = '1' OR tag IS NULL")
def flt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.with_tag(line_reads(spark, sf_dir), "AA", 1, keep_missing=True).select("id")


@query("flt4_read_group", f"WITH {READ_SQL} SELECT id FROM reads WHERE rg = 'O'")
def flt4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.of_read_group(line_reads(spark, sf_dir), "O").select("id")


@query("src17_read_groups", f"WITH {READ_SQL} SELECT rg AS read_group, count(*)::BIGINT AS n FROM reads GROUP BY 1")
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_reads(spark, sf_dir).groupBy(F.col("tags")["RG"].alias("read_group")).agg(F.count(F.lit(1)).alias("n"))


@query("src19_tag_probe", "SELECT true AS has_group")
def src19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_reads(spark, sf_dir).limit(1).select(F.map_contains_key("tags", F.lit("RG")).alias("has_group"))


@query(
    "src3_clamp_regions",
    """SELECT o_orderkey AS id, 'c' || o_custkey AS ref_name, greatest(0, o_orderkey % 900 - 100)::BIGINT AS "start", least(1000, CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE o_orderkey % 1400 + 900 END)::BIGINT AS "end" FROM orders""",
)
def src3(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    ref = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    regions = table(spark, sf_dir, "orders").select(ref("o_custkey").alias("ref_name"), (key % 900 - 100).alias("start"), F.when(key % 3 != 0, key % 1400 + 900).alias("end"), key.alias("id"))
    contigs = table(spark, sf_dir, "customer").select(ref("c_custkey").alias("ref_name"), F.lit(1000).cast("long").alias("length"))
    kept = regions.withColumn("_tag", F.struct("id"))
    joined = reads.clamp_regions(kept.select("ref_name", "start", "end").distinct(), contigs)
    wide = F.coalesce(F.col("end"), F.lit(1000).cast("long"))
    keyed = regions.withColumn("_s", F.greatest(F.lit(0).cast("long"), F.col("start"))).withColumn("_e", F.least(F.lit(1000).cast("long"), wide))
    same = (keyed["ref_name"] == joined["ref_name"]) & (keyed["_s"] == joined["start"]) & (keyed["_e"] == joined["end"])
    return keyed.join(joined, same, "left_semi").select("id", "ref_name", F.col("_s").alias("start"), F.col("_e").alias("end"))


@query(
    "src12_chunk_index",
    """WITH c AS (SELECT o_custkey AS ref_name, o_orderkey AS id, (o_orderkey * 7 % 400)::BIGINT AS a, (o_orderkey * 7 % 400 + 20 + o_orderkey % 60)::BIGINT AS z FROM orders)
    SELECT ref_name, id, row_number() OVER (PARTITION BY ref_name ORDER BY a, z DESC, id)::BIGINT AS place FROM c""",
)
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("ref_name").orderBy("a", F.desc("z"), "id")).cast("long")
    return order_chunks(spark, sf_dir).select("ref_name", "id", place.alias("place"))


@query("src10_fetch_overlap", "SELECT p_partkey AS id FROM part WHERE p_partkey % 5 = 1 AND p_partkey + len(p_name) > 100 AND p_partkey < 600")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).cast("string").alias("chrom"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("ref"))
    return readers.fetch(rows, "1", 100, 600).select("id")


@query("snk7_info_table", "SELECT 'c' AS chrom, p_partkey + 1 AS pos, p_name AS ref, p_type AS alt, p_brand AS \"BR\", CASE WHEN p_size > 25 THEN p_size::VARCHAR END AS \"SZ\" FROM part")
def snk7(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = F.map_filter(F.create_map(F.lit("BR"), F.col("p_brand"), F.lit("SZ"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string"))), lambda k, v: v.isNotNull())
    rows = table(spark, sf_dir, "part").select(
        F.lit("c").alias("chrom"), F.col("p_partkey").alias("pos"), F.lit(".").alias("id"), F.col("p_name").alias("ref"), F.array("p_type").alias("alt"), F.lit(None).cast("double").alias("qual"),
        F.array(F.lit("PASS")).alias("filter"), info.alias("info"),
    )
    return variants.info_table(rows, ["BR", "SZ"]).drop("id", "qual", "filter")


@query(
    "snk2_vcf_lines",
    "SELECT p_partkey AS pos, 'c' || chr(9) || (p_partkey + 1) || chr(9) || '.' || chr(9) || substr(p_type, 1, 1) || chr(9) || 'T,G' || chr(9) || '12.500' || chr(9) || 'PASS' || chr(9) || 'BR=' || p_brand || chr(9) || 'GT:GQ' || chr(9) || '0/1:' || p_size AS line FROM part",
)
def snk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    rows = table(spark, sf_dir, "part").select(
        F.lit("c").alias("chrom"), F.col("p_partkey").alias("pos"), F.lit(None).cast("string").alias("id"), F.substring("p_type", 1, 1).alias("ref"), F.array(F.lit("T"), F.lit("G")).alias("alt"),
        F.lit(12.5).alias("qual"), F.array(F.lit("PASS")).alias("filter"), F.create_map(F.lit("BR"), F.col("p_brand")).alias("info"),
        F.array(pair("GT", F.lit("0/1")), pair("GQ", F.col("p_size").cast("string"))).alias("genotype"),
    )
    return writers.vcf_lines(rows).select("pos", "line")


@query("snk14_region_text", f"""WITH {ORDERS_SQL} SELECT id, 'chr' || ref_name || ':' || "start" || '-' || "end" AS line FROM spans""")
def snk14(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.concat(F.lit("chr"), F.col("ref_name").cast("string"))
    return spans(spark, sf_dir).select("id", S.region_format(ref, F.col("start"), F.col("end")).alias("line"))


@query("snk6_tagged_union", f"WITH {READ_SQL} SELECT CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, coalesce(tag, '') AS tag, count(*)::BIGINT AS n FROM reads GROUP BY ALL")
def snk6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_reads(spark, sf_dir)
    both = writers.tagged_union({"even": rows.where("id % 2 = 0"), "odd": rows.where("id % 2 = 1")}, "SM")
    return both.groupBy(F.col("tags")["SM"].alias("source"), F.coalesce(F.col("tags")["AA"], F.lit("")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("flt8_region_length", f"""WITH {ORDERS_SQL} SELECT id, CASE WHEN "end" - "start" < 60 THEN 'short' ELSE 'long' END AS route FROM spans WHERE "end" - "start" >= 40""")
def flt8(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("end") - F.col("start")
    return spans(spark, sf_dir).where(size >= 40).select("id", F.when(size < 60, "short").otherwise("long").alias("route"))


@query("flt22_shorter_names", "SELECT DISTINCT p_name AS model FROM part WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_name || '@1' <> part.p_name AND contains(q.p_name || '@1', part.p_name) AND q.p_size > 45)")
def flt22(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("model")).distinct()
    versions = part.where("p_size > 45").select(F.concat("p_name", F.lit("@1")).alias("model")).distinct()
    return readers.without_shorter_names(names.unionByName(versions)).where(~F.contains("model", F.lit("@")))


@query(
    "jn14_spanning_reads_jn17",
    f"""WITH {READ_SQL}, r AS (SELECT 'c' || s_suppkey AS ref_name, k * 100 AS "start", k * 100 + 12 AS "end" FROM supplier, range(30) t(k))
    SELECT r.ref_name, r."start", count(*)::BIGINT AS n FROM reads JOIN r ON reads.ref_name = r.ref_name AND reads.pos <= r."start" AND reads.pos + reads.n >= r."end" GROUP BY ALL""",
)
def jn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("ref_name"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"))
    regions = regions.select("ref_name", (F.col("k") * 100).cast("long").alias("start"), (F.col("k") * 100 + 12).cast("long").alias("end"))
    pairs = reads.spanning(line_reads(spark, sf_dir), regions, 64)
    return pairs.groupBy(F.col("b_ref_name").alias("ref_name"), F.col("b_start").alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query("jn12_lookup_jn11", "SELECT c_custkey, n_name, coalesce(r_name, 'none') AS model FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def jn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(known, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", F.coalesce("r_name", F.lit("none")).alias("model"))


@query("jn16_known_loci", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size % 10 = l_suppkey % 10)")
def jn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "lineitem").withColumn("chrom", (F.col("l_suppkey") % 10).cast("string")).withColumn("pos", F.col("l_partkey"))
    loci = table(spark, sf_dir, "part").select((F.col("p_size") % 10).cast("string").alias("chrom"), F.col("p_partkey").alias("pos"))
    return variants.at_known_loci(records, loci).select("l_orderkey", "l_linenumber")


@query(
    "var4_merge_haplotypes_jn15",
    """WITH base AS (SELECT c_custkey AS chrom, repeat('ACGT', 30) AS seq FROM customer),
    v AS (SELECT DISTINCT o_custkey AS chrom, (o_orderkey % 13) * 9 AS pos, 1 + o_orderkey % 2 AS hap FROM orders),
    e AS (SELECT v.*, substr(seq, pos::INT + 1, 3) AS ref FROM v JOIN base USING (chrom)),
    g AS (SELECT chrom, pos, any_value(ref) AS ref, bool_or(hap = 1) AS h1, bool_or(hap = 2) AS h2 FROM e GROUP BY ALL)
    SELECT chrom, pos, ref, CASE WHEN h1 AND h2 THEN 'N,NN' WHEN h1 THEN 'N' ELSE 'NN' END AS alt, CASE WHEN h1 AND h2 THEN '1|2' WHEN h1 THEN '1|0' ELSE '0|1' END AS gt,
        CASE WHEN h1 AND h2 THEN (pos + 1 + pos + 2) / 2 WHEN h1 THEN pos + 1 ELSE pos + 2 END::DOUBLE AS qual FROM g""",
)
def var4(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chrom"), F.repeat(F.lit("ACGT"), F.lit(30)).alias("seq"))
    calls = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chrom"), (F.col("o_orderkey") % 13 * 9).alias("pos"), (1 + F.col("o_orderkey") % 2).alias("hap")).distinct()
    calls = calls.join(base, "chrom").withColumn("ref", F.substr("seq", (F.col("pos") + 1).cast("int"), F.lit(3))).drop("seq")
    hap = lambda h, alt: calls.where(F.col("hap") == h).select("chrom", "pos", "ref", F.lit(alt).alias("alt"), (F.col("pos") + h).cast("double").alias("qual"))
    return variants.merge_haplotypes(hap(1, "N"), hap(2, "NN"), base).withColumn("alt", F.array_join("alt", ","))


@query("agg24_distinct_majors", f"WITH {OBS_SQL} SELECT ref_name, count(DISTINCT major)::BIGINT AS n, count(DISTINCT major) > 3 AS enough FROM obs GROUP BY ref_name")
def agg24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("ref_name").agg(F.count_distinct("major").alias("n")).withColumn("enough", F.col("n") > 3)


@query("agg27_mean_pool", "SELECT label, round(avg(embedding[1]) FILTER (WHERE embedding[1] <> 0), 5) AS m0, round(avg(embedding[2]) FILTER (WHERE embedding[1] <> 0), 5) AS m1 FROM embeddings GROUP BY label")
def agg27(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.get("embedding", F.lit(0)) != 0)
    return rows.groupBy("label").agg(*[F.round(F.avg(F.get("embedding", F.lit(k)).cast("double")), 5).alias(f"m{k}") for k in range(2)])


@query("agg10_counts_from_cells", f"WITH {OBS_SQL} SELECT ref_name, major, minor, count(*) FILTER (WHERE symbol <> '*')::BIGINT AS depth, greatest(1, count(*) FILTER (WHERE symbol <> '*' AND is_rev))::BIGINT AS rev_depth FROM obs GROUP BY ALL")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = observations(spark, sf_dir).select("ref_name", "major", "minor", F.when(F.col("symbol") == "*", 0).otherwise(1).alias("base"), F.when(F.col("is_rev"), -1).otherwise(1).alias("strand"))
    held = F.col("base") > 0
    return cells.groupBy("ref_name", "major", "minor").agg(F.count_if(held).alias("depth"), F.greatest(F.lit(1).cast("long"), F.count_if(held & (F.col("strand") == -1))).alias("rev_depth"))


@query("win18_span_groups", f"""WITH {ORDERS_SQL} SELECT "start", "end", count(*)::BIGINT AS n FROM spans GROUP BY "start", "end" """)
def win18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).groupBy("start", "end").agg(F.count(F.lit(1)).alias("n"))


@query(
    "win19_run_coordinates",
    """WITH s AS (SELECT item_id AS id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark), c AS (SELECT id, unnest(string_split(seq, '')) AS b, unnest(range(len(seq))) AS i FROM s WHERE seq <> ''),
    n AS (SELECT id, i, coalesce(lag(b) OVER (PARTITION BY id ORDER BY i) <> b, true)::INT AS new FROM c)
    SELECT id, i::INT AS position, (sum(new) OVER (PARTITION BY id ORDER BY i) - 1)::INT AS run FROM n""",
)
def win19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq")).where("seq <> ''")
    starts = rows.select("id", F.posexplode(S.run_starts(F.col("seq"))).alias("run", "start"), F.length("seq").alias("n"))
    nxt = F.coalesce(F.lead("start").over(W.partitionBy("id").orderBy("run")), F.col("n"))
    return starts.withColumn("stop", nxt - 1).select("id", F.explode(F.sequence("start", "stop")).alias("position"), "run")


@query(
    "ivl5_fill_gaps",
    """WITH c AS (SELECT conv_id, bool_or(turn = 0) AS t0, bool_or(turn = 2) AS t2 FROM conversations GROUP BY conv_id)
    SELECT conv_id AS ref_name, CASE WHEN t0 THEN 'ABCDE' ELSE 'NNNNN' END || repeat('N', 35) || CASE WHEN t2 THEN 'ABCDE' ELSE 'NNNNN' END || repeat('N', 15) AS seq FROM c""",
)
def ivl5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pieces = turns.where("turn in (0, 2)").select(F.col("conv_id").alias("ref_name"), (F.col("turn") * 20).alias("start"), (F.col("turn") * 20 + 4).alias("stop"), F.lit("ABCDE").alias("seq")).distinct()
    draft = turns.select(F.col("conv_id").alias("ref_name")).distinct().withColumn("seq", F.repeat(F.lit("x"), F.lit(60)))
    return consensus.fill_gaps(pieces, draft, "N")


@query("srt7_gaps_descending", f"""WITH {ORDERS_SQL} SELECT id, "end" - "start" AS n FROM spans ORDER BY n DESC, id LIMIT 50""")
def srt7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select("id", (F.col("end") - F.col("start")).alias("n")).orderBy(F.desc("n"), "id").limit(50)


@query("srt4_length_name_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY strlen(text) DESC, turn DESC)::BIGINT AS place FROM conversations")
def srt4(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc(F.octet_length("text")), F.desc("turn"))).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", place.alias("place"))


@query("set4_union_with_source", "SELECT 'o' AS source, o_custkey AS id FROM orders UNION ALL SELECT 'e', user_id FROM events")
def set4(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.lit("o").alias("source"), F.col("o_custkey").alias("id"))
    return orders.unionByName(table(spark, sf_dir, "events").select(F.lit("e").alias("source"), F.col("user_id").alias("id")))


@query("set3_distinct_regions", f"""WITH {ORDERS_SQL} SELECT DISTINCT ref_name, "start", "end" FROM spans""")
def set3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select("ref_name", "start", "end").dropDuplicates()


@query(
    "str12_record_names",
    "SELECT l_orderkey, l_linenumber, 'q_' || l_orderkey || '_c' || l_suppkey || '_1_9_0_10_fwd_' || l_linenumber || '_7_2' AS name, 'q_' || l_orderkey AS query_name, 'c' || l_suppkey AS ref_name, l_linenumber::BIGINT AS hap FROM lineitem",
)
def str12(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    fixed = [F.lit(x) for x in (1, 9, 0, 10)]
    name = S.record_name(text("q_", "l_orderkey"), text("c", "l_suppkey"), *fixed, F.lit("fwd"), F.col("l_linenumber"), F.lit(7), F.lit(2))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name")).withColumn("p", S.record_name_parse(F.col("name")))
    return rows.select("l_orderkey", "l_linenumber", "name", "p.query_name", "p.ref_name", "p.hap")


@query("arr2_pad_reads", "WITH t AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_concat(a, list_transform(range(greatest(0, 8 - len(a))), lambda x: 0)), ',') AS padded FROM t")
def arr2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    return lists.select("l_orderkey", F.array_join(S.pad_array(F.col("a"), 8, F.lit(0)), ",").alias("padded"))


@query(
    "var10_diploid_calls",
    """WITH e AS (SELECT vec_id, substr('ACGT', (vec_id % 4 + 1)::INT, 1) AS r, list_transform(embedding[1:15], lambda x: x::DOUBLE) AS x FROM embeddings),
    s AS (SELECT vec_id, r, list_transform(x, lambda v: exp(v - list_max(x))) AS y FROM e), p AS (SELECT vec_id, r, list_transform(y, lambda v: v / list_sum(y)) AS p FROM s),
    b AS (SELECT vec_id, r, list_max(p) AS m, ['**', '*A', '*C', '*G', '*T', 'AA', 'AC', 'AG', 'AT', 'CC', 'CG', 'CT', 'GG', 'GT', 'TT'][list_position(p, list_max(p))] AS d FROM p),
    c AS (SELECT vec_id, r, m, substr(d, 1, 1) AS a, substr(d, 2, 1) AS b FROM b WHERE NOT contains(d, '*'))
    SELECT vec_id AS pos, r AS ref, CASE WHEN a = b THEN CASE WHEN a = r THEN '' ELSE a END WHEN a = r THEN b WHEN b = r THEN a ELSE a || ',' || b END AS alt,
        CASE WHEN a = r AND b = r THEN '0/0' WHEN a <> r AND b <> r AND a <> b THEN '1/2' WHEN a = r OR b = r THEN '0/1' ELSE '1/1' END AS gt, round(-10 * log10(greatest(1e-7, 1 - m)), 4) AS qual FROM c""",
)
def var10(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, 15), lambda x: x.cast("double"))
    ref = F.substr(F.lit("ACGT"), (F.col("vec_id") % 4 + 1).cast("int"), F.lit(1))
    rows = table(spark, sf_dir, "embeddings").select(F.lit("r").alias("ref_name"), F.col("vec_id").alias("major"), F.lit(0).alias("minor"), ref.alias("ref_symbol"), consensus.softmax(logits).alias("probs"))
    called = variants.diploid_calls(rows, labels.diploid_classes())
    return called.select("pos", "ref", F.array_join("alt", ",").alias("alt"), "gt", F.round("qual", 4).alias("qual"))


@query("var11_genotype_alleles", "SELECT p_partkey, p_size % 2 = 0 AS phased, substr(p_type, 1, 1) || ',' || CASE p_size % 3 WHEN 0 THEN substr(p_type, 1, 1) WHEN 1 THEN p_name ELSE p_brand END AS alleles FROM part")
def var11(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = F.concat(F.lit("0"), F.when(F.col("p_size") % 2 == 0, "|").otherwise("/"), (F.col("p_size") % 3).cast("string"))
    told = variants.genotype_alleles(F.substring("p_type", 1, 1), F.array("p_name", "p_brand"), gt)
    return table(spark, sf_dir, "part").select("p_partkey", told["phased"].alias("phased"), F.array_join(told["alleles"], ",").alias("alleles"))


@query(
    "var14_padded_haplotypes",
    "SELECT item_id AS pos, substr(text, 6, 10) || 'X' || substr(text, 18, 10) AS hap, substr(text, 6, 22) AS ref_hap FROM benchmark",
)
def var14(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    reference = items.select(F.col("item_id").cast("string").alias("chrom"), F.col("text").alias("seq"))
    records = items.select(F.col("item_id").cast("string").alias("chrom"), F.lit(15).cast("long").alias("pos"), F.substr("text", F.lit(16), F.lit(2)).alias("ref"), F.array(F.lit("X")).alias("alt"))
    haps = variants.padded_haplotypes(records, reference, 10)
    return haps.select(F.col("chrom").cast("long").alias("pos"), F.get("haps", F.lit(1)).alias("hap"), F.get("haps", F.lit(0)).alias("ref_hap"))


@query(
    "con3_stitch_chunks",
    """WITH c AS (SELECT o_custkey AS ref_name, o_orderkey AS id, (o_orderkey * 7 % 400)::BIGINT AS a, (o_orderkey * 7 % 400 + 20 + o_orderkey % 60)::BIGINT AS z FROM orders),
    m AS (SELECT DISTINCT ref_name, unnest(range(a, z + 1)) AS major FROM c), n AS (SELECT *, coalesce(major - lag(major) OVER (PARTITION BY ref_name ORDER BY major) > 1, true)::INT AS new FROM m),
    k AS (SELECT *, sum(new) OVER (PARTITION BY ref_name ORDER BY major) AS piece FROM n)
    SELECT ref_name, min(major)::BIGINT AS "start", max(major)::BIGINT AS stop, coalesce(string_agg(substr('ACGT', (major % 5)::INT, 1), '' ORDER BY major) FILTER (WHERE major % 5 > 0), '') AS seq FROM k GROUP BY ref_name, piece""",
)
def con3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of class probabilities, each one row, decoded and stitched."""
    likely = F.array(*[F.array(*[F.lit(0.9 if k == n else 0.025) for k in range(5)]) for n in range(5)])
    places = order_samples(spark, sf_dir).withColumn("_likely", likely)
    samples = places.withColumn("cells", F.transform("cells", lambda c: F.struct(c["major"].alias("major"), c["minor"].alias("minor"), F.get("_likely", (c["major"] % 5).cast("int")).alias("probs"))))

    def called(c: Column) -> Column:
        symbol, quality = consensus.call(c["probs"])
        return F.struct(c["major"].alias("major"), c["minor"].alias("minor"), symbol.alias("symbol"), phred_char(quality).alias("qual_char"))

    pieces = consensus.stitch_samples(samples.select("ref_name", "sample_id", F.transform("cells", called).alias("cells")))
    return pieces.select(F.col("ref_name").cast("long").alias("ref_name"), "start", "stop", F.coalesce("seq", F.lit("")).alias("seq"))


@query(
    "snk13_chunk_bed",
    """WITH c AS (SELECT o_custkey AS ref_name, (o_orderkey * 7 % 400)::BIGINT AS s, (o_orderkey * 7 % 400 + 21 + o_orderkey % 60)::BIGINT AS e FROM orders),
    a AS (SELECT *, max(e) OVER (PARTITION BY ref_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
    b AS (SELECT *, sum(coalesce(s > reach, true)::INT) OVER (PARTITION BY ref_name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM a)
    SELECT ref_name, min(s) AS "start", max(e) AS "end" FROM b GROUP BY ref_name, island""",
)
def snk13(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = order_chunks(spark, sf_dir).select("ref_name", F.col("a").alias("start"), (F.col("z") + 1).alias("end"))
    return intervals.merge(chunks, ["ref_name"]).drop("n")


@query(
    "flt24_trim_to_region",
    f"""WITH {PILE_SQL} SELECT ref_name, major, minor FROM pile WHERE major >= 5 AND major < 40""",
)
def flt24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pile(spark, sf_dir).where("major >= 5 and major < 40").select("ref_name", "major", "minor")


@query(
    "flt7_depth_filter_pieces",
    f"""WITH {OBS_SQL}, pos AS (SELECT ref_name, major, minor, count(*) AS depth FROM obs GROUP BY ALL HAVING count(*) >= 2),
    a AS (SELECT *, coalesce(major - lag(major) OVER (PARTITION BY ref_name ORDER BY major, minor) > 1, true)::INT AS new FROM pos)
    SELECT ref_name, major, minor, sum(new) OVER (PARTITION BY ref_name ORDER BY major, minor)::BIGINT AS piece FROM a""",
)
def flt7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.contiguous(positions(spark, sf_dir).where("depth >= 2"), ["ref_name"]).select("ref_name", "major", "minor", "piece")


@query("mod1_batched_model")
def mod1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority-vote model run on chunks of normalised counts. No SQL: batches of arrays go through a model."""
    encoded = encoders.feature_array(encoders.encode(observations(spark, sf_dir).where("mapq >= 1"), {"type": "counts"}))
    chunks = islands.chunks(encoded.select("ref_name", "major", "minor", "features"), ["ref_name"], ["major", "minor"], 20, 5)
    packed = chunks.groupBy("ref_name", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "features"))), lambda c: c["features"]).alias("features"))
    probs = encoders.predict(packed, encoders.majority_model, ["ref_name", "chunk"])
    return probs.select("ref_name", "chunk", F.size("probs").alias("n"), F.round(F.aggregate(F.flatten("probs"), F.lit(0.0), lambda t, p: t + p), 3).alias("mass"))


@query("tdm3_prephased_reads", """WITH h AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM lineitem WHERE l_linestatus = 'O'),
    n AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM h GROUP BY ALL), c AS (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS place FROM n),
    d AS (SELECT h.* FROM h JOIN c USING (l_suppkey, l_returnflag) WHERE place = 1),
    s AS (SELECT l_suppkey, count(*) AS k, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM d GROUP BY 1)
    SELECT l_suppkey, count(*)::BIGINT AS n FROM d JOIN s USING (l_suppkey) WHERE k <= 5 OR (l_extendedprice >= q1 - (q3 - q1) * 2 AND l_extendedprice <= q3 + (q3 - q1) * 2) GROUP BY 1""")
def tdm3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select("l_suppkey", "l_returnflag", "l_extendedprice")
    kept = tandem.without_outliers(tandem.dominant(rows, ["l_suppkey"], "l_returnflag"), ["l_suppkey"], "l_extendedprice")
    return kept.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("arr8_move_table_dwells", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '10,5,15' ELSE '15,5,10' END AS dwells FROM part")
def arr8(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = F.array(*map(F.lit, [1, 0, 1, 1, 0, 0]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.move_table_dwells(moves, F.lit(5), F.col("p_size") % 2 == 1), ",").alias("dwells"))


@query("arr10_feature_groups", f"WITH {OBS_SQL} SELECT ref_name, count(*) FILTER (is_rev)::BIGINT AS rev, count(*) FILTER (NOT is_rev)::BIGINT AS fwd FROM obs GROUP BY 1")
def arr10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each group of count columns, by strand, adds up to on a reference."""
    groups = {s: sum((F.col(c) for c in pileup.COUNTS if c.startswith(s)), F.lit(0)) for s in ("rev", "fwd")}
    counted = pileup.counts(observations(spark, sf_dir))
    return counted.groupBy("ref_name").agg(*[F.sum(total).cast("long").alias(s) for s, total in groups.items()])
