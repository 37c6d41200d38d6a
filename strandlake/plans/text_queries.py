"""Sequence, tag, name and variant queries: texts of documents and parts are sequences and alleles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import align, edit_align, poa, run_space, tandem, variants
from ..operators.windows import windowed
from . import pipelines
from .registry import query, table

_DNA_SQL = "dna AS (SELECT item_id AS id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark)"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters A, C, G and T of benchmark texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


@query("str1_reverse_complement", "SELECT doc_id, md5(reverse(translate(text, 'ACGTacgt', 'TGCAtgca'))) AS seq_md5 FROM documents")
def str1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.reverse_complement(F.col("text"))).alias("seq_md5"))


_CIGAR_SQL = "cig AS (SELECT l_orderkey AS k, l_linenumber AS i, l_linenumber || 'S' || l_quantity::INT || '=' || (l_partkey % 9 + 1) || 'D' || (l_suppkey % 5 + 1) || 'I' || (l_partkey % 4 + 1) || '=3X' AS cigar FROM lineitem)"


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    text = F.concat(
        s("l_linenumber"), F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("="), (F.col("l_partkey") % 9 + 1).cast("string"), F.lit("D"),
        (F.col("l_suppkey") % 5 + 1).cast("string"), F.lit("I"), (F.col("l_partkey") % 4 + 1).cast("string"), F.lit("=3X"),
    )
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), text.alias("cigar"))


@query(
    "str2_cigar_lengths",
    f"""WITH {_CIGAR_SQL}, o AS (SELECT k, i, cigar, list_zip(regexp_extract_all(cigar, '(\\d+)(\\D)', 1), regexp_extract_all(cigar, '(\\d+)(\\D)', 2)) AS z FROM cig)
    SELECT k, i, cigar, list_sum(list_transform(z, lambda x: CASE WHEN x[2] IN ('M', '=', 'X', 'D', 'N') THEN x[1]::INT ELSE 0 END))::INT AS on_ref,
        list_sum(list_transform(z, lambda x: CASE WHEN x[2] IN ('M', '=', 'X', 'I', 'S') THEN x[1]::INT ELSE 0 END))::INT AS on_read FROM o""",
)
def str2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cigar")
    return cigars(spark, sf_dir).select("k", "i", "cigar", S.cigar_length(c, S.ON_REFERENCE).alias("on_ref"), S.cigar_length(c, S.ON_READ).alias("on_read"))


@query("str3_trim_cigar", f"WITH {_CIGAR_SQL} SELECT k, i, regexp_replace(cigar, '^\\d+S', '') AS cigar, regexp_extract(cigar, '^(\\d+)S', 1)::INT AS query_trim, 0 AS ref_offset FROM cig")
def str3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cigars(spark, sf_dir).select("k", "i", S.trim_cigar_start(F.col("cigar")).alias("t")).select("k", "i", "t.cigar", "t.query_trim", "t.ref_offset")


@query("str4_add_clipping", f"WITH {_CIGAR_SQL} SELECT k, i, (regexp_extract(cigar, '^(\\d+)S', 1)::INT + 4) || 'S' || regexp_replace(cigar, '^\\d+S', '') || '6S' AS cigar FROM cig")
def str4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cigars(spark, sf_dir).select("k", "i", S.add_clipping(F.col("cigar"), 4, 6).alias("cigar"))


@query(
    "str6_compress_homopolymers",
    f"""WITH {_DNA_SQL}, c AS (SELECT id, unnest(string_split(seq, '')) AS b, unnest(range(1, len(seq) + 1)) AS i FROM dna),
    n AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY id ORDER BY i) <> b, true)::INT AS new FROM c), r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM n),
    g AS (SELECT id, run, any_value(b) AS b, count(*) AS n FROM r GROUP BY id, run)
    SELECT id, string_agg(b, '' ORDER BY run) AS seq, string_agg(chr((least(n, 93) + 33)::INT), '' ORDER BY run) AS runs FROM g GROUP BY id""",
)
def str6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).where("seq <> ''").select("id", S.compress_homopolymers(F.col("seq")).alias("c")).select("id", "c.seq", "c.runs")


@query(
    "str5_block_run_lengths",
    f"""WITH {_DNA_SQL}, c AS (SELECT id, unnest(string_split(repeat(seq, 1), '')) AS b, unnest(range(1, len(seq) + 1)) AS i FROM dna),
    n AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY id ORDER BY i) <> b, true)::INT AS new FROM c), r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM n),
    g AS (SELECT id, run, any_value(b) AS b, count(*) AS n FROM r GROUP BY id, run), k AS (SELECT id, run, b, n, unnest(range(0, (n - 1) // 2 + 1)) AS j FROM g)
    SELECT id, string_agg(b, '' ORDER BY run, j) AS seq, string_agg(chr((least(n - 2 * j, 2) + 33)::INT), '' ORDER BY run, j) AS runs FROM k GROUP BY id""",
)
def str5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).where("seq <> ''").select("id", S.compress_homopolymers(F.col("seq"), block=2).alias("c")).select("id", "c.seq", "c.runs")


_INFO_SQL = "i AS (SELECT p_partkey, 'TY=' || replace(p_type, ' ', '_') || ';BR=' || replace(p_brand, '#', '') || ';SZ=' || p_size || CASE WHEN p_size % 2 = 0 THEN ';EVEN' ELSE '' END AS info FROM part)"


def infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("TY="), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(";BR="), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(";SZ="), F.col("p_size").cast("string"),
        F.when(F.col("p_size") % 2 == 0, ";EVEN").otherwise(""),
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("info"))


@query(
    "str7_info_string",
    "SELECT p_partkey, 'BR=' || replace(p_brand, '#', '') || CASE WHEN p_size % 2 = 0 THEN ';EVEN' ELSE '' END || ';SZ=' || p_size || ';TY=' || replace(p_type, ' ', '_') AS info FROM part",
)
def str7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infos(spark, sf_dir).select("p_partkey", S.info_to_string(S.string_to_info(F.col("info"))).alias("info"))


@query("str8_info_values", "SELECT p_partkey, replace(p_brand, '#', '') AS brand, p_size AS size, p_size % 2 = 0 AS even FROM part")
def str8(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = infos(spark, sf_dir).select("p_partkey", S.string_to_info(F.col("info")).alias("t"))
    return tags.select("p_partkey", F.col("t")["BR"].alias("brand"), F.col("t")["SZ"].cast("int").alias("size"), F.map_contains_key("t", F.lit("EVEN")).alias("even"))


@query(
    "str11_sample_names",
    "SELECT o_orderkey, 'c' || o_custkey || ':' || o_orderkey || '.0-' || (o_orderkey + 10) || '.2' AS name, 'c' || o_custkey AS ref_name, o_orderkey AS start_major, o_orderkey + 10 AS end_major, 2::BIGINT AS end_minor FROM orders",
)
def str11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    name = S.sample_name(ref, F.col("o_orderkey"), F.lit(0), F.col("o_orderkey") + 10, F.lit(2))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")).withColumn("p", S.sample_name_parse(F.col("name")))
    return rows.select("o_orderkey", "name", "p.ref_name", "p.start_major", "p.end_major", "p.end_minor")


@query(
    "ivl2_region_strings",
    """SELECT o_orderkey, 'chr' || o_custkey AS ref_name, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey WHEN 2 THEN 0 END AS "start", CASE o_orderkey % 4 WHEN 0 THEN o_orderkey + 50 WHEN 2 THEN o_orderkey + 50 END AS "end" FROM orders""",
)
def ivl2(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    stop = (F.col("o_orderkey") + 50).cast("string")
    tail = F.when(kind == 0, F.concat(F.lit(":"), key, F.lit("-"), stop)).when(kind == 1, F.concat(F.lit(":"), key, F.lit("-"))).when(kind == 2, F.concat(F.lit(":-"), stop)).otherwise("")
    text = F.concat(F.lit("chr"), F.col("o_custkey").cast("string"), tail)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.region_parse(text).alias("r")).select("o_orderkey", "r.ref_name", "r.start", "r.end")


_ALLELE_SQL = "al AS (SELECT p_partkey AS id, p_partkey % 100 AS pos, upper(replace(p_name, ' ', '')) AS ref, upper(replace(p_name, ' ', '')) || substr(p_type, 1, p_size % 3) AS alt FROM part)"


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    alt = F.concat(ref, F.substr("p_type", F.lit(1), (F.col("p_size") % 3).cast("int")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).alias("pos"), ref.alias("ref"), alt.alias("alt"))


@query(
    "var6_classify",
    f"""WITH {_ALLELE_SQL} SELECT id, CASE WHEN len(alt) = len(ref) THEN CASE WHEN len(ref) = 1 THEN 'snp' ELSE 'mnp' END WHEN len(alt) > len(ref) AND starts_with(alt, ref) THEN CASE WHEN len(alt) = len(ref) + 1 THEN 'sni' ELSE 'mni' END ELSE 'indel' END AS kind FROM al""",
)
def var6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alleles(spark, sf_dir).select("id", variants.classify(F.col("ref"), F.array("alt")).alias("kind"))


@query(
    "set9_class_groups_snk8",
    f"""WITH {_ALLELE_SQL}, k AS (SELECT CASE WHEN len(alt) = len(ref) THEN CASE WHEN len(ref) = 1 THEN 'snp' ELSE 'mnp' END WHEN len(alt) = len(ref) + 1 THEN 'sni' ELSE 'mni' END AS kind FROM al),
    g(kind, class_group) AS (VALUES ('snp', 'sub'), ('mnp', 'sub'), ('sni', 'ins'), ('mni', 'ins'), ('sni', 'indel'), ('mni', 'indel'), ('sni', 'snid'), ('mni', 'mnid'))
    SELECT class_group, count(*)::BIGINT AS n FROM k JOIN g USING (kind) GROUP BY 1 UNION ALL SELECT 'all', count(*)::BIGINT FROM k""",
)
def set9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = alleles(spark, sf_dir).select(variants.classify(F.col("ref"), F.array("alt")).alias("kind"))
    return variants.by_class_group(kinds).groupBy("class_group").agg(F.count(F.lit(1)).alias("n"))


@query(
    "var1_trim",
    f"""WITH {_ALLELE_SQL}, p AS (SELECT id, pos, ref AS r0, 'X' || substr(ref, 2) AS a0 FROM al),
    q AS (SELECT *, CASE WHEN len(r0) = len(a0) THEN 1 END AS one FROM p) SELECT id, pos, substr(r0, 1, 1) AS ref, 'X' AS alt FROM q WHERE one = 1""",
)
def var1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alleles(spark, sf_dir).withColumn("alt", F.concat(F.lit("X"), F.expr("substr(ref, 2)")))
    return rows.select("id", variants.trim(F.col("pos"), F.col("ref"), F.col("alt")).alias("t")).select("id", "t.pos", "t.ref", "t.alt")


@query(
    "var3_split_haplotypes",
    f"""WITH {_ALLELE_SQL}, h AS (SELECT id, ref, alt, 1 AS haplotype, id % 2 AS n FROM al UNION ALL SELECT id, ref, alt, 2, id % 3 FROM al)
    SELECT id, haplotype, CASE n WHEN 1 THEN alt ELSE 'N' END AS alt FROM h WHERE n > 0""",
)
def var3(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = F.format_string("%d|%d", F.col("id") % 2, F.col("id") % 3)
    rows = alleles(spark, sf_dir).withColumn("gt", gt).withColumn("alt", F.array("alt", F.lit("N")))
    return variants.split_haplotypes(rows).select("id", "haplotype", "alt")


@query(
    "var5_split_mnp",
    """WITH a AS (SELECT p_partkey AS id, p_partkey AS pos, substr(upper(p_name), 1, 4) AS ref, substr(p_type, 1, 4) AS alt FROM part), k AS (SELECT *, unnest(range(4)) AS i FROM a)
    SELECT id, pos + i AS pos, substr(ref, i::INT + 1, 1) AS ref, substr(alt, i::INT + 1, 1) AS alt, '0/1' AS gt FROM k WHERE substr(ref, i::INT + 1, 1) <> substr(alt, i::INT + 1, 1)""",
)
def var5(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.substring(F.upper("p_name"), 1, 4).alias("ref"), F.array(F.substring("p_type", 1, 4)).alias("alt"), F.lit("0/1").alias("gt")
    )
    return variants.split_mnp(rows).withColumn("alt", F.array_join("alt", ","))


@query(
    "str17_apply_variants",
    """SELECT item_id AS id, md5(substr(text, 1, 5) || 'XY' || substr(text, 8, 12) || substr(text, 24)) AS seq_md5 FROM benchmark""",
)
def str17(spark: SparkSession, sf_dir: str) -> DataFrame:
    edit = lambda pos, n, alt: F.struct(F.lit(pos).cast("long").alias("pos"), F.substr("text", F.lit(pos + 1), F.lit(n)).alias("ref"), F.lit(alt).alias("alt"))
    edits = F.array(edit(5, 2, "XY"), edit(19, 4, ""))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.md5(S.apply_edits(F.col("text"), edits)).alias("seq_md5"))


@query(
    "flt11_valid_symbols",
    """SELECT conv_id, turn, regexp_full_match(text, '[A-Ta-t]*') AS valid, len(list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[A-Ta-t]*')))::INT AS n_valid
    FROM conversations""",
)
def flt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn is of valid symbols, and how many of its words are."""
    words = F.filter(F.split("text", " "), lambda w: S.valid_symbols(w, "A-Ta-t"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.valid_symbols(F.col("text"), "A-Ta-t").alias("valid"), F.when(F.col("text").isNotNull(), F.size(words)).alias("n_valid"))


@query("mth10_saturation", "SELECT event_id, least(127, floor(value)::INT)::INT AS dwell FROM events")
def mth10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.least(F.lit(127), F.floor("value").cast("int")).alias("dwell"))


@query(
    "src18_discover_models",
    "WITH f AS (SELECT props FROM events ORDER BY event_id LIMIT 100) SELECT DISTINCT regexp_extract(props, '\"(\\w+)\"', 1) AS name FROM f",
)
def src18(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = table(spark, sf_dir, "events").orderBy("event_id").limit(100)
    return head.select(F.regexp_extract("props", r'"(\w+)"', 1).alias("name")).distinct()


@query("aln1_local_alignment")
def aln1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's letters against those of the next: score, start and CIGAR. No SQL: a dynamic program."""
    rows = dna(spark, sf_dir)
    nxt = rows.select((F.col("id") - 1).alias("id"), F.col("seq").alias("ref"))
    found = rows.join(nxt, "id").withColumn("a", align.align(F.col("seq"), F.col("ref")))
    return found.select("id", "a.score", "a.start", "a.cigar")


_EDITED_SQL = r"""plain AS (SELECT doc_id, regexp_replace(text, '[^\x02-\x7F]', '~', 'g') AS ref FROM documents),
    marked AS (SELECT doc_id, ref, regexp_replace(ref, '(.{96}).', '\1' || chr(1), 'gs') AS marked FROM plain)"""


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (name, ref) with every 97th symbol replaced by one that no text has."""
    plain = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.regexp_replace("text", r"[^\x02-\x7F]", "~").alias("ref"))
    return plain.withColumn("query", F.regexp_replace("ref", "(?s)(.{96}).", "$1\x01"))


@query(
    "aln3_chunked_edits",
    f"""WITH {_EDITED_SQL}, cut AS (SELECT doc_id, ref, regexp_replace(marked, '(.{{210}}).', '\\1', 'gs') AS query FROM marked)
    SELECT doc_id AS name, levenshtein(query, ref)::BIGINT AS edits, len(query)::BIGINT AS aligned, len(ref)::BIGINT AS spanned FROM cut WHERE len(query) > 0""",
)
def aln3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against an edited copy, in pieces of 1,500 symbols and chunks of 400: edits in all, and what the chain of chunks covers."""
    pairs = edited(spark, sf_dir).withColumn("query", F.regexp_replace("query", "(?s)(.{210}).", "$1"))
    parts = edit_align.align_long(pairs, chunk=400, pad=200, piece=1500, anchor=20)
    ends = F.sum(F.when(F.col("first"), F.col("q_end") - F.col("q_start")).otherwise(F.col("q_end") - F.col("q_start") - F.col("shared")))
    order = W.partitionBy("name").orderBy("piece", "part")
    chained = parts.withColumn("before", F.lag("q_end").over(order)).withColumn("first", F.col("before").isNull()).withColumn("shared", F.col("before") - F.col("q_start"))
    on_ref = S.cigar_length(F.col("cigar"), S.ON_REFERENCE) - F.coalesce("shared", F.lit(0))
    return chained.groupBy("name").agg(F.sum("edits").alias("edits"), ends.alias("aligned"), F.sum(on_ref).cast("long").alias("spanned"))


@query("var15_consensus_variants", f"WITH {_EDITED_SQL} SELECT doc_id::VARCHAR AS ref_name, pos, substr(ref, pos + 1, 1) AS ref, chr(1) AS alt FROM marked, unnest(range(96, len(ref), 97)) r(pos)")
def var15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the edited copy against its document, in pieces of 1,500 symbols."""
    pairs = edited(spark, sf_dir).select(F.col("name").cast("string").alias("ref_name"), "query", F.col("ref").alias("seq"))
    return pipelines.variants_of_consensus(pairs, ambiguous=True, chunk=400, pad=200, piece=1500, anchor=20)


@query("aln6_star_consensus")
def aln6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of each conversation's turns as sub-reads of one molecule. No SQL: multiple alignment."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.regexp_replace(F.upper("text"), "[^A-Z]", "").alias("seq"))
    return align.star_consensus(rows.where("seq <> ''"), ["conv_id"])


def _subreads(seq: str) -> list[tuple[int, str]]:
    """Seven ways to misread a sequence, each wrong at other places: bases dropped, replaced, doubled."""
    edits = [(13, "$1"), (17, "$1"), (19, "$1N"), (23, "$1N"), (29, "$1$2$2"), (31, "$1$2$2"), (37, "$1")]
    return [(k, f"regexp_replace({seq}, '(.{{{m - 1}}})(.)', '{to}')") for k, (m, to) in enumerate(edits)]


@query("aln6_poa_consensus", f"WITH {_DNA_SQL} SELECT id, seq FROM dna WHERE seq <> ''")
def aln6_poa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of seven misread copies of each benchmark item's letters: the letters."""
    rows = dna(spark, sf_dir).where("seq <> ''")
    reads = rows.select("id", F.explode(F.array(*[F.expr(e) for _, e in _subreads("seq")])).alias("seq"))
    return poa.molecule_consensus(reads, ["id"])


@query(
    "tdm4_sequence_alleles",
    f"""WITH {_DNA_SQL} SELECT id, CASE WHEN len(seq) >= 17 THEN 4 ELSE 7 END::BIGINT AS n1, CASE WHEN len(seq) >= 17 THEN 3 ELSE 0 END::BIGINT AS n2, seq AS a1,
    CASE WHEN len(seq) >= 17 THEN regexp_replace(seq, '(.{{16}}).', '\\1N', 'g') END AS a2 FROM dna WHERE seq <> ''""",
)
def tdm4_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four reads of each benchmark item's letters, three with every 17th replaced: two alleles of equal length."""
    rows = dna(spark, sf_dir).where("seq <> ''")
    other = F.regexp_replace("seq", "(.{16}).", "$1N")
    reads = rows.select("id", F.explode(F.concat(F.array_repeat("seq", 4), F.array_repeat(other, 3))).alias("seq"))
    clustered = poa.sequence_clusters(reads, ["id"])
    sizes = clustered.groupBy("id").agg(F.count_if(F.col("cluster") == 1).alias("n1"), F.count_if(F.col("cluster") == 2).alias("n2"))
    called = poa.molecule_consensus(clustered.select("id", "cluster", "seq"), ["id", "cluster"])
    pair = called.groupBy("id").agg(F.max(F.when(F.col("cluster") == 1, F.col("seq"))).alias("a1"), F.max(F.when(F.col("cluster") == 2, F.col("seq"))).alias("a2"))
    return sizes.join(pair, "id")


@query("agg15_ambiguous_alleles")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by best allele. No SQL: alignment scores."""
    rows = dna(spark, sf_dir).where("seq <> ''")
    reads = rows.select((F.col("id") % 5).alias("site"), F.col("id").alias("read_id"), (F.col("id") % 2 == 1).alias("is_rev"), "seq")
    haps = reads.groupBy("site").agg(F.array_sort(F.collect_set("seq")).alias("all")).select("site", F.posexplode("all").alias("allele", "hap"))
    return align.best_alleles(reads, haps, ["site"])


@query(
    "sets8_read_sets",
    """WITH p AS (SELECT l_orderkey, list(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS a, list(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY 1)
    SELECT l_orderkey, len(list_intersect(coalesce(a, []), coalesce(b, [])))::INT AS both, len(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))::INT AS any_of FROM p""",
)
def set8(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda test: F.collect_set(F.when(test, F.col("l_linenumber")))
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(of(F.col("l_returnflag") == "R").alias("a"), of(F.col("l_linestatus") == "O").alias("b"))
    return sets.select("l_orderkey", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("any_of"))


@query("agg22_length_totals", "SELECT l_suppkey, count(*)::BIGINT AS n, sum(l_quantity) AS total, max(l_quantity) AS longest FROM lineitem GROUP BY 1")
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tandem.route_regions(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity").select("l_suppkey", "n", "longest")
    return rows.join(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total")), "l_suppkey")


def _one_a_run(seq: str) -> str:
    for symbol in "ACGTN":
        seq = f"regexp_replace({seq}, '{symbol}+', '{symbol}', 'g')"
    return seq


@query(
    "aln8_run_space",
    rf"""WITH d AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS ref FROM documents), r AS (SELECT doc_id, ref, substr(ref, 8) AS slice,
        regexp_replace(substr(ref, 8), '(.{{28}}).', '\1N', 'g') AS core FROM d WHERE len(ref) > 7)
    SELECT doc_id::VARCHAR AS qname, (len({_one_a_run("substr(ref, 1, 8)")}) - 1)::BIGINT AS run_pos, (len({_one_a_run("core")}) + 1)::BIGINT AS n_runs,
        levenshtein({_one_a_run("core")}, {_one_a_run("slice")})::INT AS edits, 7::BIGINT AS pos, (len(core) + 3)::INT AS on_read, len(slice)::INT AS on_ref FROM r""",
)
def aln8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters A, C, G and T of each document from the eighth on, every 29th replaced, as a clipped read of the whole: realigned in run space, and back over bases."""
    refs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ref_name"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    core = F.substr("seq", F.lit(8))
    read = refs.where(F.length("seq") > 7).select(
        F.col("ref_name").alias("qname"), "ref_name", F.lit(0).alias("flag"), F.lit(7).alias("pos"), F.concat(F.lit("3S"), F.length(core).cast("string"), F.lit("M")).alias("cigar"),
        F.concat(F.lit("NNN"), F.regexp_replace(core, "(.{28}).", "$1N")).alias("seq"),
    )
    short = run_space.compress_alignments(read, windowed(refs))
    back = S.cigar_length(F.col("full"), S.ON_READ).alias("on_read"), S.cigar_length(F.col("full"), S.ON_REFERENCE).alias("on_ref")
    full = short.withColumn("full", run_space.expand_cigar(F.col("cigar"), F.col("query_runs"), F.col("ref_runs")))
    return full.select("qname", F.col("pos").alias("run_pos"), F.length("seq").cast("long").alias("n_runs"), "edits", F.col("base_pos").alias("pos"), *back)
