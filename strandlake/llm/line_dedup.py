"""Line deduplication by a log-template tree, in DataFrame functions only.

A line's words are cut at white space; words with a digit, an @ or :// are variable
and become a wildcard. The tree has a fixed depth: number of words, then the first
``lead`` words. In a leaf, a line belongs to the template of all its
constant words, and, if long enough, to four templates that each leave one quarter of the
words after the leading ones variable, so lines that differ within a quarter
share a template. A line whose template occurs in ``min_docs`` documents or more is
dropped from all of them. Templates are counted with two grouped sums, so a line of
a third of all documents is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

WILD, LEAD, QUARTERS, MIN_WORDS, MIN_DOCS = "<*>", 3, 4, 3, 3
#: Words after the leading ones from which on quarters are left variable.
MIN_REST = 8
VARIABLE = r"\S*(?:[0-9@]|://)\S*"


def _hashed_parts(words: str) -> list[Column]:
    """Hashes of the leading words and of each quarter of the rest, so that every word is hashed once."""
    rest = F.size(words) - LEAD
    bounds = [F.floor(rest * q / QUARTERS).cast("int") for q in range(QUARTERS + 1)]
    quarters = [F.xxhash64(F.slice(words, bounds[q] + LEAD + 1, bounds[q + 1] - bounds[q])).alias(f"q{q}") for q in range(QUARTERS)]
    return [F.size(words).alias("n"), F.xxhash64(F.slice(words, 1, LEAD)).alias("lead"), *quarters]


def _keys() -> Column:
    """Hashes of the templates a line belongs to: with all its words, and with each quarter left variable."""
    quarters = [f"q{q}" for q in range(QUARTERS)]
    open_keys = [F.xxhash64(F.lit(q), "n", "lead", *[x for x in quarters if x != f"q{q}"]) for q in range(QUARTERS)]
    whole = F.xxhash64(F.lit(-1), "n", "lead", *quarters)
    return F.when(F.col("n") - LEAD >= MIN_REST, F.array(whole, *open_keys)).otherwise(F.array(whole))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, dropped): for each document that loses lines, the numbers, from 0, of those lines. Row: see ``_row``."""
    lines = docs.select(_row(id_col, text_col).alias("row"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("line_no", "line"))
    line = F.trim("line")
    line = F.when(line.rlike(r"[0-9@]|://"), F.regexp_replace(line, VARIABLE, WILD)).otherwise(line)
    lines = lines.select("row", "line_no", F.array_remove(F.split(line, r"\s+"), "").alias("words"))
    constant = ~F.array_contains("words", WILD) | (F.size(F.array_remove("words", WILD)) > 0)
    lines = lines.where((F.size("words") >= MIN_WORDS) & constant).select("row", "line_no", *_hashed_parts("words"))
    keys = materialise(lines.select("row", "line_no", F.explode(_keys()).alias("key")), "line-keys")
    spread = keys.groupBy("key", "row").agg(F.count(F.lit(1)).alias("n"))
    often = spread.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select("key")
    return keys.join(often, "key", "left_semi").groupBy("row").agg(F.collect_set("line_no").alias("dropped"))


def _row(id_col: str, text_col: str) -> Column:
    """A row's key: id and text. Rows that repeat both are one document."""
    return F.xxhash64(F.lit("row"), F.col(id_col).cast("string"), text_or_empty(text_col))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` plus kept_text, n_lines and n_dropped. Blank lines and lines of fewer than MIN_WORDS words stay; null text is one blank line."""
    dropped = recurring_lines(docs, id_col, text_col, min_docs).select(F.col("row").alias("_line_row"), F.col("dropped").alias("_line_dropped"))
    joined = docs.withColumn("_line_row", _row(id_col, text_col)).join(dropped, "_line_row", "left")
    lines = F.split(text_or_empty(text_col), "\n")
    stay = F.filter(lines, lambda line, at: ~F.array_contains("_line_dropped", at))
    kept = F.when(F.col("_line_dropped").isNull(), text_or_empty(text_col)).otherwise(F.array_join(stay, "\n"))
    return joined.select(
        *[joined[c] for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")],
        kept.alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_line_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def oracle_sql(min_docs: int = MIN_DOCS) -> str:
    """The query ``op5`` in DuckDB's SQL, with templates in place of their hashes."""
    quarters = " UNION ALL ".join(
        f"""SELECT doc_id, line_no, '{q} ' || n || ' ' || array_to_string(words[1:{LEAD}], ' ') || chr(1)
            || array_to_string(words[{LEAD + 1}:{LEAD} + (n - {LEAD}) * {q} // {QUARTERS}], ' ') || chr(1)
            || array_to_string(words[{LEAD + 1} + (n - {LEAD}) * {q + 1} // {QUARTERS}:n], ' ') AS key FROM lines WHERE n - {LEAD} >= {MIN_REST}"""
        for q in range(QUARTERS)
    )
    return f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    raw AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM split),
    flat AS (SELECT doc_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g'), ' ') AS line FROM raw),
    cut AS (SELECT doc_id, line_no, string_split(regexp_replace(line, '{VARIABLE}', '{WILD}', 'g'), ' ') AS words FROM flat),
    lines AS (SELECT *, len(words) AS n FROM cut WHERE len(words) >= {MIN_WORDS} AND len(list_filter(words, lambda w: w != '{WILD}')) > 0),
    keys AS (SELECT doc_id, line_no, 'all ' || array_to_string(words, ' ') AS key FROM lines UNION ALL {quarters}),
    often AS (SELECT key FROM keys GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
    gone AS (SELECT doc_id, list_distinct(list(line_no)) AS dropped FROM keys JOIN often USING (key) GROUP BY doc_id)
    SELECT doc_id, len(parts)::BIGINT AS n_lines, coalesce(len(dropped), 0)::BIGINT AS n_dropped,
        sha256(CASE WHEN dropped IS NULL THEN array_to_string(parts, chr(10))
            ELSE coalesce(array_to_string(list_filter(parts, lambda x, i: NOT list_contains(dropped, i - 1)), chr(10)), '') END) AS kept_sha256
    FROM split LEFT JOIN gone USING (doc_id)"""
