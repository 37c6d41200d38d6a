"""Pileup, consensus and label queries: events are observations, embeddings are class probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import phred, phred_char
from ..operators import consensus, labels, pileup, variants
from .registry import OBS_SQL, observations, query, table

COUNTS_SQL = ", ".join(
    f"count(*) FILTER (WHERE symbol = '{'*' if s == 'del' else s.upper()}' AND {'is_rev' if w == 'rev' else 'NOT is_rev'})::BIGINT AS {w}_{s}"
    for w, s in (c.split("_") for c in pileup.COUNTS)
)
ALL_SQL = " + ".join(pileup.COUNTS)
PILE_SQL = f"{OBS_SQL}, pile AS (SELECT ref_name, major, minor, {COUNTS_SQL} FROM obs WHERE mapq >= 1 GROUP BY ref_name, major, minor)"
DEEP_SQL = f"{PILE_SQL}, deep AS (SELECT *, first_value({ALL_SQL}) OVER (PARTITION BY ref_name, major ORDER BY minor) AS depth FROM pile)"


def pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.counts(observations(spark, sf_dir).where("mapq >= 1"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


@query("agg1_pileup_counts", f"WITH {PILE_SQL} SELECT * FROM pile")
def agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pile(spark, sf_dir)


@query("agg2_insertion_columns", f"WITH {OBS_SQL} SELECT ref_name, major, max(minor)::INT AS max_ins, count(DISTINCT minor)::BIGINT AS n_columns FROM obs GROUP BY ref_name, major")
def agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).groupBy("ref_name", "major")
    return rows.agg(F.max("minor").alias("max_ins"), F.count_distinct("minor").alias("n_columns"))


@query("agg3_datatype_counts", f"WITH {OBS_SQL} SELECT ref_name, major, minor, event_id % 3 AS datatype, {COUNTS_SQL} FROM obs WHERE mapq >= 1 GROUP BY ALL")
def agg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.counts(observations(spark, sf_dir).where("mapq >= 1").withColumn("datatype", F.col("event_id") % 3), ("datatype",))


@query(
    "agg4_quality_strata",
    f"WITH {OBS_SQL} SELECT ref_name, major, minor, CASE WHEN symbol = '*' THEN 0 ELSE greatest(0, least(quality, 3) - 1) END AS stratum, {COUNTS_SQL} FROM obs GROUP BY ALL",
)
def agg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.strata(observations(spark, sf_dir), 3)


@query(
    "agg5_weibull_counts",
    f"""WITH {OBS_SQL}, x AS (SELECT *, unnest(range(1, 6)) AS run_length, 1 + mapq % 3 AS shape, 1 + event_id % 5 AS scale FROM obs),
    m AS (SELECT *, pow((run_length - 1) / scale, shape) AS a, pow(run_length / scale, shape) AS b FROM x)
    SELECT ref_name, major, minor, run_length::INT AS run_length, sum(floor(greatest(0, exp(-a) - exp(-b)) * 10000))::BIGINT AS weight FROM m GROUP BY ALL""",
)
def agg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("shape", 1 + F.col("mapq") % 3).withColumn("scale", 1 + F.col("event_id") % 5)
    return pileup.weibull_counts(obs, 5)


@query("agg6_depth_jn8_parent", f"WITH {DEEP_SQL} SELECT ref_name, major, minor, depth::BIGINT AS depth FROM deep")
def agg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.depth(pile(spark, sf_dir)).select("ref_name", "major", "minor", "depth")


@query(
    "agg7_norm_total",
    f"WITH {DEEP_SQL} SELECT ref_name, major, minor, depth::BIGINT AS depth, " + ", ".join(f"round({c} / greatest(1, depth), 6) AS {c}" for c in pileup.COUNTS) + " FROM deep",
)
def agg7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pileup.normalise_total(pile(spark, sf_dir)), *pileup.COUNTS)


_STRAND_SQL = ", ".join(
    f"first_value({' + '.join(c for c in pileup.COUNTS if c.startswith(w))}) OVER (PARTITION BY ref_name, major ORDER BY minor) AS {w}_depth" for w in ("rev", "fwd")
)


@query(
    "agg8_norm_fwd_rev",
    f"WITH {PILE_SQL}, deep AS (SELECT *, {_STRAND_SQL} FROM pile) SELECT ref_name, major, minor, rev_depth::BIGINT AS rev_depth, fwd_depth::BIGINT AS fwd_depth, "
    + ", ".join(f"round({c} / greatest(1, {c[:3]}_depth), 6) AS {c}" for c in pileup.COUNTS)
    + " FROM deep",
)
def agg8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pileup.normalise_strands(pile(spark, sf_dir)), *pileup.COUNTS)


@query(
    "agg9_symmetric_indels",
    f"WITH {PILE_SQL}, deep AS (SELECT *, {_STRAND_SQL} FROM pile) SELECT ref_name, major, minor, "
    + ", ".join(
        f"CASE WHEN minor > 0 THEN {c[:3]}_depth - ({' + '.join(x for x in pileup.COUNTS if x.startswith(c[:3]))}) ELSE {c} END::BIGINT AS {c}" if c.endswith("del") else c
        for c in pileup.COUNTS
    )
    + " FROM deep",
)
def agg9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.symmetric_indels(pile(spark, sf_dir)).select(*pileup.POSITION, *pileup.COUNTS)


_BASE_SQL = ", ".join(f"(rev_{s} + fwd_{s}) / greatest(1, depth) AS p_{s}" for s in pileup.SYMBOLS)
_MAJ_SQL = f"""{DEEP_SQL}, parts AS (SELECT ref_name, major, minor, {_BASE_SQL}, (rev_del + fwd_del) / greatest(1, depth) AS g FROM deep),
    probs AS (SELECT *, g + greatest(0, 1 - g - (p_a + p_c + p_g + p_t)) AS p_gap FROM parts)"""


@query("agg19_majority_probs", f"WITH {_MAJ_SQL} SELECT ref_name, major, minor, round(p_gap, 6) AS p_gap, round(p_a, 6) AS p_a, round(p_c, 6) AS p_c, round(p_g, 6) AS p_g, round(p_t, 6) AS p_t FROM probs")
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pileup.majority_probs(pile(spark, sf_dir))
    named = [F.round(F.get("probs", F.lit(k)), 6).alias(n) for k, n in enumerate(("p_gap", "p_a", "p_c", "p_g", "p_t"))]
    return rows.select(*pileup.POSITION, *named)


_DEC_SQL = f"""{_MAJ_SQL}, arr AS (SELECT *, [p_gap, p_a, p_c, p_g, p_t] AS p FROM probs),
    decoded AS (SELECT ref_name, major, minor, p, substr('*ACGT', list_position(p, list_max(p))::INT, 1) AS symbol,
        least(70, -10 * log10(least(1, greatest(1e-7, 1 - list_max(p))))) AS quality FROM arr)"""


@query("agg26_majority_consensus", f"WITH {_DEC_SQL} SELECT ref_name, major, minor, symbol, round(quality, 4) AS quality FROM decoded")
def agg26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consensus.decode(pileup.majority_probs(pile(spark, sf_dir)))
    return rows.select(*pileup.POSITION, "symbol", F.round("quality", 4).alias("quality"))


@query(
    "con1_consensus_sequence",
    f"WITH {_DEC_SQL} SELECT ref_name, string_agg(symbol, '' ORDER BY major, minor) AS seq, count(*)::BIGINT AS n FROM decoded WHERE symbol <> '*' GROUP BY ref_name",
)
def con1(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = consensus.decode(pileup.majority_probs(pile(spark, sf_dir)))
    return consensus.sequences(decoded, ["ref_name"]).select("ref_name", "seq", F.length("seq").cast("long").alias("n"))


@query(
    "con2_run_length_consensus",
    f"WITH {OBS_SQL} SELECT ref_name, string_agg(repeat(symbol, 1 + quality % 3), '' ORDER BY major, minor, event_id) AS seq FROM obs WHERE symbol <> '*' GROUP BY ref_name",
)
def con2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where("symbol <> '*'").withColumn("minor", F.struct("minor", "event_id")).withColumn("run", 1 + F.col("quality") % 3)
    return consensus.run_length_sequences(rows, ["ref_name"], "symbol", "run")


_SOFT_SQL = """e AS (SELECT vec_id, label, list_transform(embedding[1:5], lambda x: x::DOUBLE) AS x FROM embeddings),
    ex AS (SELECT vec_id, label, list_transform(x, lambda v: exp(v - list_max(x))) AS y FROM e),
    soft AS (SELECT vec_id, label, list_transform(y, lambda v: v / list_sum(y)) AS p FROM ex)"""


def softmaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", consensus.softmax(logits).alias("probs"))


@query("mth8_softmax", f"WITH {_SOFT_SQL} SELECT vec_id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2, round(p[4], 6) AS p3, round(p[5], 6) AS p4 FROM soft")
def mth8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return softmaxed(spark, sf_dir).select("vec_id", *[F.round(F.get("probs", F.lit(k)), 6).alias(f"p{k}") for k in range(5)])


@query(
    "agg17_argmax_phred",
    f"""WITH {_SOFT_SQL} SELECT vec_id, (list_position(p, list_max(p)) - 1)::INT AS best, round(list_max(p), 6) AS prob,
    round(least(70, -10 * log10(least(1, greatest(1e-7, 1 - list_max(p))))), 4) AS quality FROM soft""",
)
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.array_max("probs")
    return softmaxed(spark, sf_dir).select("vec_id", consensus.argmax(F.col("probs")).alias("best"), F.round(top, 6).alias("prob"), F.round(phred(1 - top), 4).alias("quality"))


@query(
    "agg18_top_two",
    f"""WITH {_SOFT_SQL}, i AS (SELECT vec_id, unnest(p) AS q, unnest(range(5)) AS k FROM soft),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, k DESC) AS place FROM i)
    SELECT vec_id, max(CASE WHEN place = 1 THEN k END)::INT AS first, max(CASE WHEN place = 2 THEN k END)::INT AS second FROM r GROUP BY vec_id""",
)
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = softmaxed(spark, sf_dir).select("vec_id", consensus.top_two(F.col("probs")).alias("t"))
    return top.select("vec_id", F.get("t", F.lit(0)).alias("first"), F.get("t", F.lit(1)).alias("second"))


@query(
    "str9_phred_chars",
    f"WITH {_SOFT_SQL}, q AS (SELECT vec_id, unnest(p) AS v, unnest(range(5)) AS k FROM soft) SELECT vec_id, string_agg(chr((floor(least(70, -10 * log10(least(1, greatest(1e-7, 1 - v))))) + 33)::INT), '' ORDER BY k) AS qual FROM q GROUP BY vec_id",
)
def str9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return softmaxed(spark, sf_dir).select("vec_id", F.array_join(F.transform("probs", lambda p: phred_char(phred(1 - p))), "").alias("qual"))


@query(
    "agg20_accuracy_mth3_q",
    f"""WITH {_SOFT_SQL}, r AS (SELECT label, (label % 5 = list_position(p, list_max(p)) - 1)::INT AS hit FROM soft)
    SELECT label, count(*)::BIGINT AS n, sum(hit)::BIGINT AS correct, round(avg(hit), 6) AS accuracy, round(-10 * log10(greatest(1e-6, 1 - avg(hit))), 4) AS q FROM r GROUP BY label""",
)
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = softmaxed(spark, sf_dir).select("label", (F.col("label") % 5).alias("truth"), consensus.argmax(F.col("probs")).alias("best"))
    found = labels.accuracy(rows, ["label"], "truth", "best")
    return found.select("label", "n", "correct", F.round("accuracy", 6).alias("accuracy"), F.round("q", 4).alias("q"))


@query(
    "var9_snp_calls",
    f"""WITH {_MAJ_SQL}, u AS (SELECT ref_name, major, substr('ACGT', (major % 4 + 1)::INT, 1) AS ref_symbol, unnest([p_gap, p_a, p_c, p_g, p_t]) AS q, unnest(range(5)) AS k FROM probs WHERE minor = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY ref_name, major ORDER BY q DESC, k DESC) AS place FROM u),
    t AS (SELECT ref_name, major, ref_symbol, max(CASE WHEN place = 1 THEN substr('*ACGT', k::INT + 1, 1) END) AS s1, max(CASE WHEN place = 2 THEN substr('*ACGT', k::INT + 1, 1) END) AS s2,
        max(CASE WHEN place = 1 THEN q END) AS p1, max(CASE WHEN place = 2 THEN q END) AS p2 FROM r GROUP BY ALL),
    c AS (SELECT *, p2 >= 0.04 AND s2 <> '*' AS two FROM t WHERE s1 <> '*')
    SELECT ref_name, major AS pos, ref_symbol AS ref,
        CASE WHEN NOT two THEN CASE WHEN s1 = ref_symbol THEN '' ELSE s1 END WHEN s1 = ref_symbol THEN s2 WHEN s2 = ref_symbol THEN s1 ELSE s1 || ',' || s2 END AS alt,
        CASE WHEN NOT two THEN CASE WHEN s1 = ref_symbol THEN '0/0' ELSE '1/1' END WHEN s1 = ref_symbol OR s2 = ref_symbol THEN '0/1' ELSE '1/2' END AS gt,
        round(least(70, -10 * log10(least(1, greatest(1e-7, CASE WHEN two THEN 1 - p1 - p2 ELSE 1 - p1 END)))), 4) AS qual FROM c""",
)
def var9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pileup.majority_probs(pile(spark, sf_dir)).withColumn("ref_symbol", F.substr(F.lit("ACGT"), (F.col("major") % 4 + 1).cast("int"), F.lit(1)))
    return variants.snp_calls(rows).withColumn("alt", F.array_join("alt", ",")).withColumn("qual", F.round("qual", 4))


@query(
    "win10_variant_columns",
    f"""WITH {_DEC_SQL}, d AS (SELECT ref_name, major, minor, symbol <> CASE WHEN minor = 0 THEN substr('ACGT', (major % 4 + 1)::INT, 1) ELSE '*' END AS differs FROM decoded)
    SELECT ref_name, major, minor, CASE WHEN minor = 0 THEN differs ELSE bool_or(differs) OVER (PARTITION BY ref_name, major) END AS is_var FROM d""",
)
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_columns(with_reference(spark, sf_dir)).select(*pileup.POSITION, "is_var")


def with_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consensus.decode(pileup.majority_probs(pile(spark, sf_dir)))
    ref = F.when(F.col("minor") == 0, F.substr(F.lit("ACGT"), (F.col("major") % 4 + 1).cast("int"), F.lit(1))).otherwise("*")
    rows = rows.withColumn("ref_symbol", ref).withColumn("prob", F.array_max("probs"))
    return rows.withColumn("ref_prob", F.get("probs", F.instr(F.lit("*ACGT"), F.col("ref_symbol")) - 1))


@query(
    "var7_decode_variants",
    f"""WITH {_DEC_SQL}, d AS (SELECT *, CASE WHEN minor = 0 THEN substr('ACGT', (major % 4 + 1)::INT, 1) ELSE '*' END AS r FROM decoded),
    v AS (SELECT *, CASE WHEN minor = 0 THEN symbol <> r ELSE bool_or(symbol <> r) OVER (PARTITION BY ref_name, major) END AS is_var,
        least(70, -10 * log10(least(1, greatest(1e-7, 1 - list_max(p))))) - least(70, -10 * log10(least(1, greatest(1e-7, 1 - p[instr('*ACGT', r)])))) AS q FROM d),
    f AS (SELECT *, coalesce(lag(is_var) OVER w <> is_var, true)::INT AS new, last_value(CASE WHEN minor = 0 THEN r END IGNORE NULLS) OVER (PARTITION BY ref_name ORDER BY major, minor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM v WINDOW w AS (PARTITION BY ref_name ORDER BY major, minor)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY ref_name ORDER BY major, minor) AS run FROM f),
    g AS (SELECT ref_name, run, arg_min(major, (major, minor)) AS m0, arg_min(minor, (major, minor)) AS n0, coalesce(arg_min(coalesce(before, ''), (major, minor)), '') AS b,
        replace(string_agg(r, '' ORDER BY major, minor), '*', '') AS ref, replace(string_agg(symbol, '' ORDER BY major, minor), '*', '') AS alt, sum(q) AS qual FROM n WHERE is_var GROUP BY ref_name, run),
    l AS (SELECT *, (n0 > 0 OR ref = '' OR alt = '') AS lead FROM g)
    SELECT ref_name, CASE WHEN lead AND n0 = 0 AND NOT m0 = 0 THEN m0 - 1 ELSE m0 END AS pos, CASE WHEN lead AND NOT (n0 = 0 AND m0 = 0) THEN b ELSE '' END || ref AS ref,
        CASE WHEN lead AND NOT (n0 = 0 AND m0 = 0) THEN b ELSE '' END || alt AS alt, round(qual, 3) AS qual FROM l
    WHERE ref <> alt""",
)
def var7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.decode(with_reference(spark, sf_dir)).withColumn("qual", F.round("qual", 3))


@query(
    "var13_annotate_depth",
    f"""WITH {PILE_SQL} SELECT o_orderkey AS id, o_custkey AS chrom, o_orderkey % 100 AS pos, coalesce(fwd_a + fwd_c + fwd_g + fwd_t + fwd_del, 0)::BIGINT AS dp_fwd,
    coalesce(rev_a + rev_c + rev_g + rev_t + rev_del, 0)::BIGINT AS dp_rev, coalesce({ALL_SQL}, 0)::BIGINT AS dp
    FROM orders LEFT JOIN pile ON o_custkey = ref_name AND o_orderkey % 100 = major AND minor = 0""",
)
def var13(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chrom"), (F.col("o_orderkey") % 100).alias("pos"))
    return variants.annotate_depth(records, pile(spark, sf_dir))


@query(
    "jn7_label_join",
    f"""WITH {PILE_SQL}, t AS (SELECT o_custkey AS ref_name, o_orderkey % 100 AS major, 0 AS minor, min(o_orderkey % 5)::INT AS label FROM orders GROUP BY ALL)
    SELECT pile.ref_name, pile.major, pile.minor, coalesce(t.label, 0)::INT AS label FROM pile LEFT JOIN t USING (ref_name, major, minor)""",
)
def jn7(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ref_name"), (F.col("o_orderkey") % 100).alias("major"), F.lit(0).alias("minor"), (F.col("o_orderkey") % 5).cast("int").alias("label"))
    truth = truth.groupBy("ref_name", "major", "minor").agg(F.min("label").alias("label"))
    return labels.join_labels(pile(spark, sf_dir).select(*pileup.POSITION), truth, pileup.POSITION)


@query("map3_label_codes", f"WITH {OBS_SQL} SELECT event_id, (list_position(['*', 'A', 'C', 'G', 'T'], symbol) - 1)::INT AS label FROM obs")
def map3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("event_id", labels.encode(F.col("symbol"), labels.haploid_classes()).alias("label"))


@query("flt2_min_mapq", f"WITH {OBS_SQL} SELECT event_id, mapq FROM obs WHERE mapq >= 50")
def flt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where("mapq >= 50").select("event_id", "mapq")
