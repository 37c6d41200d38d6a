"""Fingerprints of documents that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A document is the set of its paragraphs' digests; the k-th occurrence of a paragraph is an element of its own. A sketch has a few
cells; each element is added to one cell of each third of them: a count, the XOR of digests, the XOR of check sums. Subtracting the
sketches of two versions cancels what they share. A cell that then holds one element alone gives it up; taking it out of its other
cells frees more (peeling). If cells are left, there were more differences than the sketch holds, and both versions are sketched
again with more cells, until the differences are recovered whole. Two versions of n and m paragraphs that differ in d share
(n + m - d) / 2, and their likeness is what they share over what either has.

A paragraph is a line; a long one is cut after its sentences, and a long sentence every few words, so that a version with other
words in one place keeps its other paragraphs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, text_digest, text_or_empty
from .textbatch import GOLDEN, mix64

#: Cells of a fingerprint, in thirds; the factor by which a failed one grows; words and characters of a paragraph at most.
CELLS, GROWTH, PARAGRAPH_WORDS, PARAGRAPH_CHARS = 12, 4, 8, 128
#: Characters of the texts whose versions are compared at once; ranges of ids for each shuffle partition, so that these are even.
BLOCK_CHARS, RANGES = 1 << 20, 4
_sentence = re.compile(r"[^\n.!?]*+(?:[.!?]++(?!\s)[^\n.!?]*+)*+[.!?]*+\n?")
_words = re.compile(rf"(?:\s*+\S++){{1,{PARAGRAPH_WORDS}}}+\s*+")

Elements = tuple[np.ndarray, np.ndarray]


def paragraphs(text: str) -> list[str]:
    """The text in pieces, in order, none empty; together they are the text again. A cut depends only on the sentence it is in."""
    out: list[str] = []
    for sentence in _sentence.findall(text):
        if len(sentence) <= PARAGRAPH_CHARS // 2:
            if sentence:
                out.append(sentence)
            continue
        for piece in _words.findall(sentence) or [sentence]:
            out += [piece] if len(piece) <= PARAGRAPH_CHARS else [piece[k : k + PARAGRAPH_CHARS] for k in range(0, len(piece), PARAGRAPH_CHARS)]
    return out


def digests(text: str) -> np.ndarray:
    """Digests of the paragraphs of a text, each once; occurrences of equal paragraphs are told apart by their number."""
    seen: dict[int, int] = {}
    keys = []
    for piece in paragraphs(text):
        key = xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass"))
        seen[key] = nth = seen.get(key, 0) + 1
        keys.append(key if nth == 1 else (key + nth * GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    # Elements that collide within one text would never peel.
    return np.unique(mix64(np.array(keys, dtype=np.uint64)))


def stacked(keys: list[np.ndarray]) -> Elements:
    """Row and digest of the elements of some texts."""
    return np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def checksum(key: np.ndarray) -> np.ndarray:
    return mix64(key ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)


def places(key: np.ndarray, cells: int) -> np.ndarray:
    """(n, 3) cells of each element, one in each third; other ones for another number of cells."""
    third = np.uint64(cells // 3)
    spread = [mix64(key + np.uint64(((k + 1) * 0xD1342543DE82EF95 + cells) % (1 << 64))) % third + np.uint64(k) * third for k in range(3)]
    return np.stack(spread, axis=1).astype(np.int64)


def sketch(row: np.ndarray, key: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, key sums and check sums of ``n`` rows, each (n, cells)."""
    count, keys, checks = np.zeros(n * cells, dtype=np.int64), np.zeros(n * cells, dtype=np.uint64), np.zeros(n * cells, dtype=np.uint64)
    _toggle(count, keys, checks, row, key, np.ones(len(row), dtype=np.int64), cells)
    return count.reshape(n, cells), keys.reshape(n, cells), checks.reshape(n, cells)


def _toggle(count: np.ndarray, keys: np.ndarray, checks: np.ndarray, row: np.ndarray, key: np.ndarray, sign: np.ndarray, cells: int) -> None:
    check = checksum(key)
    at = row[:, None] * cells + places(key, cells)
    for k in range(3):
        np.add.at(count, at[:, k], sign)
        np.bitwise_xor.at(keys, at[:, k], key)
        np.bitwise_xor.at(checks, at[:, k], check)


def peel(count: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements of subtracted sketches: row, key, sign (1: of the first version, -1: of the second), and which rows are whole."""
    n, cells = count.shape
    count, keys, checks = count.ravel().copy(), keys.ravel().copy(), checks.ravel().copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        pure = look[(np.abs(count[look]) == 1) & (checksum(keys[look]) == checks[look])]
        if not len(pure):
            break
        row, key, sign = pure // cells, keys[pure], count[pure]
        # An element alone in several cells is taken out once.
        order = np.lexsort((key, row))
        row, key, sign = row[order], key[order], sign[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        row, key, sign = row[new], key[new], sign[new]
        _toggle(count, keys, checks, row, key, -sign, cells)
        found.append((row, key, sign))
        look = np.unique((row[:, None] * cells + places(key, cells)).ravel())
    whole = ~(count.astype(bool) | keys.astype(bool) | checks.astype(bool)).reshape(n, cells).any(axis=1)
    row, key, sign = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return row, key, sign, whole


def differences(a: Elements, b: Elements, n: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and sign of what ``n`` pairs of versions (their elements) differ in, and the cells each pair took."""
    took, open_rows = np.zeros(n, dtype=np.int64), np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(open_rows):
        slot = np.full(n, -1)
        slot[open_rows] = np.arange(len(open_rows))
        one, two = (sketch(slot[row][(at := slot[row] >= 0)], key[at], len(open_rows), cells) for row, key in (a, b))
        row, key, sign, whole = peel(one[0] - two[0], one[1] ^ two[1], one[2] ^ two[2])
        mine = whole[row]
        out.append((open_rows[row[mine]], key[mine], sign[mine]))
        took[open_rows[whole]] = cells
        open_rows, cells = open_rows[~whole], cells * GROWTH
    row, key, sign = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return row, key, sign, took


def likeness(a: Elements, b: Elements, n: int) -> np.ndarray:
    """Of ``n`` pairs: shared elements over all; 1 where neither has any."""
    row, _, _, _ = differences(a, b, n)
    apart = np.bincount(row, minlength=n)
    both = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    shared = (both - apart) // 2
    return np.where(both > 0, shared / np.maximum(shared + apart, 1), 1.0)


def written(row: np.ndarray, key: np.ndarray, n: int) -> list[str]:
    """Fingerprints as text: the number of elements, then the cells (16-bit count, 64-bit sum, 32-bit check sum) in base 64."""
    count, keys, checks = sketch(row, key, n, CELLS)
    packed = np.zeros((n, CELLS), dtype=[("count", "<u2"), ("key", "<u8"), ("check", "<u4")])
    packed["count"], packed["key"], packed["check"] = count & 0xFFFF, keys, checks
    sizes = np.bincount(row, minlength=n)
    return [f"{size}:{base64.b64encode(cells.tobytes()).decode()}" for size, cells in zip(sizes, packed, strict=True)]


def compare(one: str, two: str) -> tuple[list[int], list[int], float] | None:
    """From two fingerprints alone: digests only the first has, only the second has, likeness; None if they differ in too much for that."""
    parts = [np.frombuffer(base64.b64decode(s.split(":")[1]), dtype=[("count", "<u2"), ("key", "<u8"), ("check", "<u4")]) for s in (one, two)]
    sizes = [int(s.split(":")[0]) for s in (one, two)]
    count = (parts[0]["count"].astype(np.int64) - parts[1]["count"] + 0x8000) % 0x10000 - 0x8000
    row, key, sign, whole = peel(count[None], (parts[0]["key"] ^ parts[1]["key"])[None], (parts[0]["check"] ^ parts[1]["check"]).astype(np.uint64)[None])
    if not whole[0]:
        return None
    shared = (sum(sizes) - len(row)) // 2
    return sorted(map(int, key[sign > 0])), sorted(map(int, key[sign < 0])), shared / (shared + len(row)) if sum(sizes) else 1.0


def _diff_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = (stacked([digests(t or "") for t in batch.column(k).to_pylist()]) for k in (1, 2))
        n = batch.num_rows
        row, key, sign, took = differences(one, two, n)
        order = np.lexsort((key, row))
        row, key, sign = row[order], key[order], sign[order]

        def lists(which: np.ndarray, row: np.ndarray = row, key: np.ndarray = key, n: int = n) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[which], minlength=n))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(key[which].view(np.int64)))

        yield pa.RecordBatch.from_arrays([batch.column(0), lists(sign > 0), lists(sign < 0), pa.array(took), pa.array(likeness(one, two, n))], names=["id", "removed", "added", "cells", "likeness"])


def differing_paragraphs(versions: DataFrame, id_col: str = "id", old: str = "old", new: str = "new") -> DataFrame:
    """id, removed and added (digests of paragraphs that only one version has), cells (size of the sketch that held them), likeness.

    Null texts are empty; equal texts differ in nothing and have likeness 1, as have two empty ones; one row for each row.
    """
    rows = versions.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{old}`").alias("old"), F.col(f"`{new}`").alias("new"))
    return map_batches(rows, _diff_batches, f"id {rows.dtypes[0][1]}, removed array<long>, added array<long>, cells long, likeness double")


RESULT = "doc_id long, digest binary, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_names = [f.strip().split(" ")[0] for f in RESULT.split(",")]
Key = tuple[bool, int, bytes]


def _key(doc_id: int | None, digest: bytes) -> Key:
    """Order of documents: by id, nulls first, then by digest of the text."""
    return doc_id is not None, doc_id or 0, digest


def _packed(batches: Iterator[pa.RecordBatch], firsts: list[Key]) -> Iterator[pa.RecordBatch]:
    """Each row with the number of its range, texts compressed; the first row of a range also as the last of the range before."""
    pack, seen = zstandard.ZstdCompressor(level=1), set()
    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        out = []
        doc_ids, keys, texts = (batch.column(k) for k in range(3))
        for at, (doc_id, digest) in enumerate(zip(doc_ids.to_pylist(), keys.to_pylist(), strict=True)):
            key = _key(doc_id, digest)
            if key in seen:
                continue
            # Rows that repeat wholly need to go once; what is remembered has a bound, and the rest is told by the reader.
            if len(seen) >= 65_536:
                seen.clear()
            seen.add(key)
            place = bisect_right(firsts, key) - 1
            text = pack.compress(texts[at].as_py())
            out.append((place, False, doc_id, digest, text))
            if firsts[place] == key:
                out.append(((place - 1) % len(firsts), True, doc_id, digest, text))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["place", "edge", "doc_id", "digest", "packed"])


#: A row of a range: its id, the digest of its text, the text, the digests of its paragraphs.
Row = tuple[int | None, bytes, str, np.ndarray]


def _compared(pairs: list[tuple[Row, Row]]) -> pa.RecordBatch:
    """The result's rows of documents and the ones after them."""
    n, texts = len(pairs), [row[2] for row, _ in pairs]
    edited = [text[: len(text) - len(text) // 2] + after[2][: len(text) // 2] for text, (_, after) in zip(texts, pairs, strict=True)]
    own, new, following = stacked([row[3] for row, _ in pairs]), stacked([digests(t) for t in edited]), stacked([after[3] for _, after in pairs])
    columns = [
        pa.array([row[0] for row, _ in pairs], pa.int64()),
        pa.array([row[1] for row, _ in pairs], pa.binary()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(written(*own, n)),
        pa.array(written(*new, n)),
        pa.array(likeness(own, new, n)),
        pa.array(likeness(own, following, n)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_names)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted within their range, each with the one after it; the last row of a range is there for the row before it only."""
    unpack, place_edge, before, waiting, size = zstandard.ZstdDecompressor(), None, None, [], 0
    for batch in batches:
        for place, edge, doc_id, digest, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if before and place_edge == (place, edge) and before[:2] == (doc_id, digest):
                continue
            text = unpack.decompress(packed).decode("utf-8", "replace")
            row = doc_id, digest, text, digests(text)
            if before and place_edge[0] == place:
                waiting.append((before, row))
                size += len(text) + len(before[2])
            place_edge, before = (place, edge), row
            if size > BLOCK_CHARS:
                yield _compared(waiting)
                waiting, size = [], 0
    if waiting:
        yield _compared(waiting)


def _with_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text.decode("utf-8", "replace")
            row = doc_id, digest, text, digests(text)
            yield _compared([(row, row)])


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the first half with the first as many characters of the next document: by ascending id (nulls first, ties by
    digest of the text), after the last the first; of a lone document, itself. Null texts are empty; rows that repeat wholly follow each
    other, so all but the last are edited with themselves. Texts are read whole; an empty table gives an empty result; other columns
    are not read. Ids are cut into as many ranges as there are shuffle partitions, by their ranks; texts are shuffled once, compressed.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_digest(text_col).alias("digest"), text_or_empty(text_col).cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]
    with Scratch(spark) as scratch:
        keys = source.select("doc_id", "digest").withColumn("part", F.spark_partition_id())
        keys = scratch.write(keys.groupBy("doc_id", "digest", "part").agg(F.count(F.lit(1)).alias("n")), "keys")
        n_ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = keys.select("doc_id", "digest").repartitionByRange(n_ranges, *order)
        firsts = ranges.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "digest")).alias("first"))
        # One row for each range reaches the driver.
        starts = sorted(_key(r["first"].doc_id, bytes(r["first"].digest)) for r in firsts.collect())
        packed = map_batches(source, lambda batches: _packed(batches, starts), "place int, edge boolean, doc_id long, digest binary, packed binary")
        dealt = packed.repartition("place").sortWithinPartitions("place", "edge", *order)
        found = scratch.write(map_batches(dealt, _in_order, RESULT), "fingerprints")
        # Of rows that repeat wholly, all but one follow themselves: as many copies of that row as each part of the table has.
        twice = keys.groupBy("doc_id", "digest").agg(F.sum("n").alias("n"), F.max("part").alias("last")).where("n > 1")
        twice = scratch.write(twice.select(F.col("doc_id").alias("i"), F.col("digest").alias("d"), "last"), "repeats")
        if not twice.isEmpty():
            same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))
            texts = source.join(twice, same, "left_semi").dropDuplicates(["doc_id", "digest"])
            selves = map_batches(texts, _with_itself, RESULT)
            slots = keys.join(twice, same).select("i", "d", (F.col("n") - (F.col("part") == F.col("last")).cast("int")).cast("int").alias("n"))
            copies = slots.join(selves, same).withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select(*_names)
            found = scratch.write(found.unionByName(copies), "fingerprints")
        return scratch.keep(found).drop("digest")
