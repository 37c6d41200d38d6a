"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts are lower-cased and cut into words. A fixed mask such as 111011 hashes
the words at its ones and ignores those at its zeros. Every position of every
document and of every benchmark item is hashed under every mask; equal hashes
are hits. A hit fixes how item and document are aligned; the aligned words are compared
one by one, and the item is found if some window of ``window`` words (all of
them, for a shorter item) agrees in at least ``agreement`` of its words. Substituted words
thus neither hide a seed, as long as one window of a mask is clean, nor fail the check.

A position's hash is looked up in the benchmark's seeds before anything is shuffled, and a hit is three numbers:
which text, which item, where the item would begin. Seeds hold no words. Only texts with hits are read again and
compared, once for all rows that share a text. The number of seeds is checked: up to ``broadcast_seeds`` they are
broadcast; beyond, positions first pass two broadcast tables of at most 2**20 hash remainders each, and
what passes is joined by a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, maybe_in, text_digest, text_or_empty

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MASKS = ("111011", "11111")
REMAINDERS = 1 << 20


def word_array(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATOR), "")


def _hashed(text: str) -> Column:
    """The hash of each word, in order."""
    return F.transform(word_array(text), lambda word: F.xxhash64(word))


def _seed(at: Column, mask: str, number: int) -> Column:
    picked = [F.get("words", at + k) for k, bit in enumerate(mask) if bit == "1"]
    hashed = F.xxhash64(F.lit(number), *picked)
    return F.when(at + len(mask) <= F.size("words"), hashed)


def _positions(df: DataFrame, key: str, masks: tuple[str, ...]) -> DataFrame:
    """One row per position and mask that fits: key, at, seed."""
    n = F.size("words") - min(map(len, masks))
    at = df.withColumn("at", F.explode(F.when(n >= 0, F.sequence(F.lit(0), n))))
    seeds = F.array(*[_seed(F.col("at"), mask, k) for k, mask in enumerate(masks)])
    return at.select(key, "at", F.explode(seeds).alias("seed")).where(F.col("seed").isNotNull())


def _found(
    docs: DataFrame,
    benchmark: DataFrame,
    scratch: Scratch,
    text_col: str,
    item_col: str,
    item_text_col: str,
    masks: tuple[str, ...],
    window: int,
    agreement: float,
    broadcast_seeds: int,
) -> DataFrame:
    """One row per text (by its digest), item and alignment that agrees: digest, item_id, start, n_matched, n_item_words; written."""
    if not masks or any(set(m) - {"0", "1"} or m[0] + m[-1] != "11" for m in masks):
        raise ValueError("a mask is made of 0 and 1, and begins and ends with 1")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), _hashed(item_text_col).alias("words")).distinct()
    items = scratch.write(items.withColumn("item_no", F.monotonically_increasing_id()), "items")
    seeds = scratch.write(_positions(items, "item_no", masks).select("seed", "item_no", F.col("at").alias("item_at")), "seeds")

    # A text is known by a hash until it is compared: two texts that share one only make each other's hits, which don't agree.
    key = F.xxhash64(text_or_empty(text_col)).alias("text_key")
    hashes = _positions(docs.select(key, _hashed(text_col).alias("words")), "text_key", masks)
    if seeds.count() <= broadcast_seeds:
        hits = hashes.join(F.broadcast(seeds), "seed")
    else:
        for name, shift in (("low", 0), ("high", 24)):
            rest = F.shiftrightunsigned("seed", shift).bitwiseAND(REMAINDERS - 1)
            held = seeds.select(rest.alias(name)).distinct()
            hashes = hashes.withColumn(name, rest).join(F.broadcast(held), name, "left_semi").drop(name)
        hits = hashes.join(seeds, "seed")
    hits = scratch.write(hits.select("text_key", "item_no", (F.col("at") - F.col("item_at")).alias("start")).distinct(), "hits")

    wanted = scratch.write(hits.select("text_key").distinct(), "hit-texts")
    texts = docs.select(key, text_or_empty(text_col).alias("text"))
    texts = maybe_in(texts, wanted, "text_key", wanted.count()).withColumn("digest", text_digest("text")).dropDuplicates(["text_key", "digest"])
    pairs = texts.select("text_key", "digest", _hashed("text").alias("words")).join(hits, "text_key")
    pairs = pairs.join(items.select("item_no", "item_id", F.col("words").alias("item_words")), "item_no")
    start, size = F.col("start"), F.size("item_words")
    at = lambda k: F.get("words", F.greatest(start + k, F.lit(0)))
    equal = F.transform("item_words", lambda word, k: F.when((start + k >= 0) & (at(k) == word), 1).otherwise(0))
    pairs = pairs.select("digest", "item_id", "start", size.alias("n_item_words"), equal.alias("equal"))
    size = F.col("n_item_words")
    span = F.least(size, F.lit(window))
    total = lambda numbers: F.aggregate(numbers, F.lit(0), lambda so_far, x: so_far + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), size - span + 1), lambda s: total(F.slice("equal", s, span))))
    agreed = pairs.where(best >= F.ceil(F.lit(agreement) * span - F.lit(1e-9)))
    return scratch.write(agreed.select("digest", "item_id", "start", total(F.col("equal")).alias("n_matched"), "n_item_words"), "found")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS,
    window: int = 20,
    agreement: float = 0.8,
    broadcast_seeds: int = 200_000,
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, start_word, n_matched, n_item_words, agreement.

    start_word: the document's word, from 0, at which the item's first word would stand; the best alignment is given,
    the earliest if several are. Null texts are empty. Items of fewer words than the shortest mask hold too little
    to be found and are left out; neither are documents that short. Rows that share an id, or have none, are one document, of
    which each text is compared. Rows that repeat add nothing. Empty tables give an empty result, long texts and items are
    compared whole, other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.keep(_found(docs, benchmark, scratch, text_col, item_col, item_text_col, masks, window, agreement, broadcast_seeds))
        gone = scratch.keep(scratch.write(found.select("digest").distinct(), "found-texts"))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"))
        rows = maybe_in(rows, gone, "digest", gone.count()).join(found, "digest")
    first = rows.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("n_matched")).alias("less"), "start", "n_item_words")).alias("top"))
    return first.select(
        "doc_id",
        "item_id",
        F.col("top.start").cast("long").alias("start_word"),
        (-F.col("top.less")).cast("long").alias("n_matched"),
        F.col("top.n_item_words").cast("long").alias("n_item_words"),
        F.round(-F.col("top.less") / F.col("top.n_item_words"), 6).alias("agreement"),
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS,
    window: int = 20,
    agreement: float = 0.8,
    broadcast_seeds: int = 200_000,
) -> DataFrame:
    """``docs`` without documents that hold a benchmark item, columns as they are. A row is judged by its own text, whatever its id."""
    with Scratch(docs.sparkSession) as scratch:
        found = _found(docs, benchmark, scratch, text_col, item_col, item_text_col, masks, window, agreement, broadcast_seeds)
        name = fresh(docs, "_digest")
        gone = scratch.keep(scratch.write(found.select(F.col("digest").alias(name)).distinct(), "found-texts"))
    return docs.withColumn(name, text_digest(text_col)).join(gone, name, "left_anti").select(*docs.columns)


def oracle_sql(masks: tuple[str, ...] = MASKS, window: int = 20, agreement: float = 0.8) -> str:
    """The same search in DuckDB's SQL, with words in place of their hashes."""
    keys = []
    for k, mask in enumerate(masks):
        picked = " || ' ' || ".join(f"words[pos + {i + 1}]" for i, bit in enumerate(mask) if bit == "1")
        keys.append(f"SELECT id, words, pos, '{k} ' || {picked} AS seed FROM {{t}}_at WHERE pos + {len(mask)} <= len(words)")
    shortest = min(map(len, masks))
    parts = []
    for t, source, key in (("d", "documents", "doc_id"), ("b", "benchmark", "item_id")):
        parts.append(
            f"{t}_words AS (SELECT DISTINCT {key} AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x != '') AS words FROM {source})"
        )
        parts.append(f"{t}_at AS (SELECT id, words, unnest(range(len(words) - {shortest - 1})) AS pos FROM {t}_words)")
        parts.append(f"{t}_seeds AS ({' UNION ALL '.join(keys).format(t=t)})")
    return f"""WITH {", ".join(parts)},
    hits AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.pos - b.pos AS start, d.words AS words, b.words AS item FROM d_seeds d JOIN b_seeds b USING (seed)),
    lined AS (SELECT doc_id, item_id, start, len(item) AS n, least(len(item), {window}) AS span,
        list_transform(range(len(item)), lambda k: CASE WHEN start + k >= 0 AND words[start + k + 1] = item[k + 1] THEN 1 ELSE 0 END) AS equal FROM hits),
    found AS (SELECT * FROM lined WHERE list_max(list_transform(range(n - span + 1), lambda s: list_sum(equal[s + 1:s + span]))) >= ceil({agreement} * span - 1e-9)),
    ranked AS (SELECT *, list_sum(equal) AS matched, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY list_sum(equal) DESC, start) AS place FROM found)
    SELECT doc_id, item_id, start::BIGINT AS start_word, matched::BIGINT AS n_matched, n::BIGINT AS n_item_words, round(matched / n, 6) AS agreement FROM ranked WHERE place = 1"""
