"""Vectorised words over Arrow string columns.

A word is a run of ASCII letters or digits or non-ASCII characters after A-Z are
lower-cased. Work is on UTF-8 bytes, where every byte of a non-ASCII character
is >= 0x80, so byte classes give the same words as character classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False
BASE, GOLDEN = 0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15
BLOCK_BYTES = 1 << 21


class _Cache(dict):
    """Stays where it is: pickled as empty."""

    def __reduce__(self) -> tuple:
        return _Cache, ()


_powers = _Cache()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Block:
    """Some rows of a batch: their bytes, and where each row begins and the last ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a block: byte ranges, hashes, and where each row's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column (null: empty) into blocks of whole texts of about ``max_bytes``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def words(block: Block) -> Words:
    """Lower-cased words of each row with 64-bit polynomial hashes."""
    n = len(block.data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(block) + 1, dtype=np.int64))
    low = LOWER[block.data]
    inside = IS_WORD[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[block.offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts])
    return Words(starts, ends, hashes, np.searchsorted(starts, block.offsets))


def hash_word(word: str) -> int:
    """The hash that ``words`` gives to one word."""
    found = words(Block(0, np.frombuffer(word.encode(), dtype=np.uint8), np.array([0, len(word.encode())])))
    if len(found.hashes) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(found.hashes[0])


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of ``size`` words; a row with fewer words, but some, has one run of all of them."""
    h, counts = found.hashes, found.counts
    factor = np.uint64(0xD1342543DE82EF95)
    total = len(h)
    rows, items = [], []
    if total >= size:
        value = np.zeros(total - size + 1, dtype=np.uint64)
        for k in range(size):
            value = value * factor + h[k : total - size + 1 + k]
        row = found.row[: total - size + 1]
        whole = np.arange(total - size + 1) + size <= found.offsets[1:][row]
        rows.append(row[whole])
        items.append(mix64(value[whole]))
    for short in range(1, size):
        at = np.flatnonzero(counts == short)
        if len(at):
            value = np.zeros(len(at), dtype=np.uint64)
            for k in range(short):
                value = value * factor + h[found.offsets[at] + k]
            rows.append(at)
            items.append(mix64(value))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(rows), np.concatenate(items)


def row_counts(rows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, item) pairs in order, and how often each occurs."""
    order = np.lexsort((items, rows))
    rows, items = rows[order], items[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (items[1:] != items[:-1])
    at = np.flatnonzero(new)
    return rows[at], items[at], np.diff(np.append(at, len(rows)))
