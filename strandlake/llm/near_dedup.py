"""MinHash near-deduplication with BagMinHash signatures.

A document is the multiset of its five-word shingles. Its signature has ``m``
registers. For every shingle, Poisson points of unit rate per unit of weight
are drawn, in ascending order, from a stream that depends on the shingle alone;
the weight axis is discretised to unit cells and split into dyadic shells
(0,1], (1,2], (2,4], (4,8], ..., each with a process of its own, so a shingle
that occurs w times draws from the shells below w only, and in the last one a
point counts if its cell is below w. A point falls into one register, and a
register keeps its earliest point. Two registers agree with probability equal
to the weighted Jaccard similarity. A process stops once its next point lies
beyond a bound by which all registers of the document are filled almost surely;
a document with an unfilled register is drawn again with twice the bound, so
signatures are exact.

Signatures are cut into bands. Documents that share a band are candidates and
are verified on whole shingle multisets. In each bucket every member is first
compared with the one that shares most buckets with others and with the smallest
one, so a bucket of copies costs its size, not its square. Members of buckets that are then still in different
components go through an exact prefix-filtered set join, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_found, map_batches, maybe_in, text_digest, text_or_empty
from .components import components
from .textbatch import GOLDEN, blocks, mix64, row_counts, shingles, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 34, 6


def bag_signatures(rows: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) registers: the bits of the earliest point. Rows without items keep infinity."""
    registers = np.full(n * m, np.inf)
    total = np.bincount(rows, weights=weights, minlength=n)
    bound = np.where(total > 0, m * (math.log(m) + 3) / np.maximum(total, 1), 0.0)
    pending = total > 0
    while pending.any():
        for shell in range(64):
            low, width = (0, 1) if shell == 0 else (1 << (shell - 1), 1 << (shell - 1))
            at = np.flatnonzero(pending[rows] & (weights > low))
            if not len(at):
                break
            _draw(registers, rows[at], mix64(items[at] ^ np.uint64(((shell + 1) * GOLDEN) % (1 << 64))), weights[at] - low, width, bound, m)
        open_rows = np.isinf(registers.reshape(n, m)).any(axis=1) & pending
        registers.reshape(n, m)[open_rows] = np.inf
        bound[open_rows] *= 2
        pending = open_rows
    return registers.view(np.uint64).reshape(n, m)


def _draw(registers: np.ndarray, row: np.ndarray, state: np.ndarray, inside: np.ndarray, width: int, bound: np.ndarray, m: int) -> None:
    """Points of one shell of each item, up to the bound of its row."""
    x, limit = np.zeros(len(row)), bound[row]
    while len(row):
        state = mix64(state + np.uint64(GOLDEN))
        x = x - np.log1p((state >> np.uint64(11)).astype(np.float64) * -(2.0**-53)) / width
        live = np.flatnonzero(x <= limit)
        if len(live) < len(row):
            row, state, x, limit, inside = row[live], state[live], x[live], limit[live], inside[live]
        spot = mix64(state ^ np.uint64(0xA0761D6478BD642F))
        register = ((spot >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        if width == 1:
            np.minimum.at(registers, row * m + register.astype(np.int64), x)
        else:
            cell = ((spot & np.uint64(0xFFFFFFFF)) * np.uint64(width)) >> np.uint64(32)
            in_weight = np.flatnonzero(cell.astype(np.int64) < inside)
            np.minimum.at(registers, row[in_weight] * m + register[in_weight].astype(np.int64), x[in_weight])


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) bucket keys; the band number is part of the key."""
    parts = registers.reshape(len(registers), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix64(key ^ parts[:, :, k]) + np.uint64(GOLDEN)
    return mix64(key)


def _signature_batches(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(batch.schema.get_field_index("text"))):
            n = len(block)
            row, item, weight = row_counts(*shingles(words(block), shingle))
            total = np.bincount(row, weights=weight, minlength=n).astype(np.int64)
            keys = band_keys(bag_signatures(row, item, weight, n, bands * rows), bands, rows)
            some = total > 0
            lengths = np.where(some, bands, 0)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(keys[some].ravel().view(np.int64))
            )
            part = batch.slice(block.first, n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(total), lists], names=["doc_id", "digest", "row_no", "weight", "bands"]
            )


def _bag_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Multisets as sets: the k-th occurrence of a shingle is an element of its own."""
    for batch in batches:
        for block in blocks(batch.column(batch.schema.get_field_index("text"))):
            n = len(block)
            row, item, weight = row_counts(*shingles(words(block), shingle))
            first = np.repeat(np.cumsum(weight) - weight, weight)
            nth = (np.arange(len(first)) - first).astype(np.uint64)
            bag = mix64(np.repeat(item, weight) + nth * np.uint64(GOLDEN))
            ends = np.cumsum(np.bincount(row, weights=weight, minlength=n)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), pa.array(bag.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, n), lists], names=["node", "bag"])


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets reach the threshold."""
    left = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    right = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    joined = pairs.join(left, "b").join(right, "a")
    return joined.where(shared >= F.lit(threshold) * (F.size("bag_a") + F.size("bag_b") - shared) - F.lit(1e-9)).select("a", "b")


def _prefix_pairs(rest: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different roots that can reach the threshold, by prefix, length and positional filters.

    Elements are ordered from rare to common. Of two multisets that reach it, the shorter one's first
    n - ceil(2t/(1+t) n) + 1 elements and the longer one's first n - ceil(t n) + 1 meet, and where they first
    meet enough elements follow in both. Near copies with many own edits begin with elements nobody shares.
    """
    elements = rest.select("node", "root", F.size("bag").alias("n"), F.explode("bag").alias("element"))
    often = elements.groupBy("element").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = elements.join(often, "element").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("order"))
    # Elements of one document alone come first and meet nothing: only their number counts.
    alone = (F.col("n") - F.size("order")).cast("int")
    reach = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1 - alone
    heads = ranked.withColumn("alone", alone).where(reach > 0).withColumn("order", F.slice("order", F.lit(1), reach.cast("int")))
    posts = heads.select("node", "root", "n", "alone", F.posexplode("order"))
    posts = posts.select(F.col("col.element").alias("element"), (F.col("alone") + F.col("pos") + 1).alias("pos"), "node", "root", "n")
    posts = scratch.write(posts, "prefixes")
    one, two = (posts.select("element", *[F.col(c).alias(f"{c}_{side}") for c in ("pos", "node", "root", "n")]) for side in "xy")
    one = one.where(F.col("pos_x") <= F.col("n_x") - F.ceil(F.lit(2 * threshold / (1 + threshold)) * F.col("n_x") - F.lit(1e-9)) + 1)
    longer = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y")))
    follow = 1 + F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    needed = F.lit(threshold / (1 + threshold)) * (F.col("n_x") + F.col("n_y")) - F.lit(1e-6)
    met = one.join(two, "element").where(longer & (F.col("root_x") != F.col("root_y")))
    met = met.where((F.col("n_x") >= F.lit(threshold) * F.col("n_y") - F.lit(1e-6)) & (follow >= needed))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, rep_id, class_no, class_id, group_size, kept.

    rep_id is the smallest id with the same text. class_no tells classes apart, also where ids are null or shared. class_id is the smallest id of the connected component of
    links of weighted Jaccard similarity >= ``threshold`` over multisets of ``shingle``-word shingles; texts
    with fewer words, but some, are one shingle. kept: the row of class_id; of rows that share that id too, one. Texts
    without words (null, empty, punctuation alone) are linked to equal texts only. Rows are told apart by a number of their
    own, so rows that share an id, or have none, are linked by their texts alone. Null ids count as smallest. An empty table
    gives an empty result; texts are read whole, however long; other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(_groups(docs, scratch, id_col, text_col, shingle, threshold, bands, rows)).drop("digest")


def _groups(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, shingle: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """``near_groups`` plus digest, written."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row_no"), text_or_empty(text_col).alias("text"))
    signed = map_batches(
        source,
        lambda batches: _signature_batches(batches, shingle, bands, rows),
        "doc_id long, digest binary, row_no long, weight long, bands array<long>",
    )
    signed = scratch.write(signed, "signatures")

    # Equal texts: one node, the number of one of their rows, speaks for all of them.
    reps = signed.groupBy("digest").agg(F.min("row_no").alias("node"), F.min(F.struct("doc_id")).alias("rep"))
    reps = scratch.write(reps.select("digest", "node", F.col("rep.doc_id").alias("rep_id")), "representatives")
    slots = signed.select("digest", "row_no", "doc_id", F.pmod("row_no", F.lit(64)).alias("salt"))
    heads = slots.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n")).join(reps, "digest").drop("n")
    members = scratch.write(slots.join(heads, ["digest", "salt"]).select("row_no", "doc_id", "digest", "node", "rep_id"), "members")

    lone = reps.select(F.col("node").alias("row_no"))
    entries = signed.join(lone, "row_no", "left_semi").select(F.col("row_no").alias("node"), F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = scratch.write(entries.join(shared, "bucket").select("bucket", "node", "n"), "buckets")
    scratch.drop(signed)

    # Copies with edits of their own may be near the text they come from and not each other; that text meets more others than they do.
    meets = held.groupBy("node").agg(F.sum("n").alias("met"))
    hub = F.max(F.struct("met", (-F.col("node")).alias("less"))).alias("hub")
    pivots = held.join(meets, "node").groupBy("bucket").agg(hub, F.min("node").alias("low"))
    pivots = scratch.write(pivots.select("bucket", (-F.col("hub.less")).alias("hub"), "low"), "pivots")
    pair = lambda pivot: F.struct(F.least("node", pivot).alias("a"), F.greatest("node", pivot).alias("b"))
    stars = held.join(pivots, "bucket").select(F.inline(F.array(pair("hub"), pair("low"))))
    stars = scratch.write(stars.where("a < b").distinct(), "star-pairs")
    wanted = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    # The texts are found again by their digests: equal ones are one node.
    wanted = scratch.write(reps.join(wanted, "node", "left_semi").select("digest", "node"), "wanted-texts")
    texts = docs.select(text_digest(text_col).alias("digest"), text_or_empty(text_col).alias("text"))
    texts = maybe_in(texts, wanted, "digest", wanted.count()).join(wanted, "digest").select("node", "text").dropDuplicates(["node"])
    bags = scratch.write(map_batches(texts, lambda batches: _bag_batches(batches, shingle), "node long, bag array<long>"), "bags")
    links = scratch.write(_verified(stars, bags, threshold), "star-links")
    grouped = components(links, scratch=scratch)

    # Buckets that stars left in different components: an exact prefix join of their members finds what links them.
    placed = held.select("bucket", "node").join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    rest = placed.join(split, "bucket").select("node", "root").distinct()
    pairs = scratch.write(_prefix_pairs(rest.join(bags, "node"), threshold, scratch).join(stars, ["a", "b"], "left_anti"), "rest-pairs")
    if not pairs.isEmpty():
        grouped = components(links.unionByName(_verified(pairs, bags, threshold)), scratch=scratch)

    roots = members.join(grouped, "node", "left")
    roots = scratch.write(roots.select("row_no", "doc_id", "digest", "rep_id", F.coalesce("root", "node").alias("root")), "classes")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "row_no")).alias("top")).where("size > 1")
    few = roots.select("root", F.pmod("row_no", F.lit(64)).alias("salt")).distinct().join(sizes, "root")
    sized = roots.withColumn("salt", F.pmod("row_no", F.lit(64))).join(few, ["root", "salt"], "left")
    alone = F.col("top").isNull()
    return scratch.write(
        sized.select(
            "doc_id",
            "rep_id",
            F.col("root").alias("class_no"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            (alone | (F.col("top.row_no") == F.col("row_no"))).alias("kept"),
            "digest",
        ),
        "groups",
    )


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, columns as they are; cases as in ``near_groups``."""
    with Scratch(docs.sparkSession) as scratch:
        found = _groups(docs, scratch, id_col, text_col, shingle, threshold, bands, rows)
        return keep_found(docs, found, scratch, id_col, text_col)
