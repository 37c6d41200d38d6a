"""Edit-distance alignment of long pairs: waves of furthest reaching diagonals, chained chunks, and anchors that make pieces independent.

A wave holds, for each diagonal, the furthest query base that a number of edits reaches; matches cost nothing, so a pair with d edits
takes d + 1 waves, each a few array operations over at most 2d + 1 diagonals. ``chain`` aligns a long query chunk by chunk: a chunk
ends on a match, the next one starts with it. ``align_long`` cuts pairs at words that occur once in both and in the same order, so a
contig's pieces are rows of a table and spread over tasks.

Ties: of equal ends the first; of equal starts the one that spans more reference; matches are taken as early as possible, then a
substitution before a deletion before an insertion.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship, spread
from .windows import WIDTH, slices, windowed

Ops = list[tuple[int, str]]
Path = tuple[int, int, Ops]
Part = tuple[int, int, int, int, Ops]
FAR = -(1 << 40)
#: Edits beyond which a chunk is cut in two, as the waves of a path take memory by their square; and beyond which a stretch without a match is passed on as it is.
MOST_EDITS = 4096
#: Diagonals that are followed one by one, each over a long stretch at a time.
FEW = 4
#: Pairs aligned side by side: the longest text, the edits after which a pair goes on by itself, and how many at a time.
SIDE_LENGTH, SIDE_EDITS, SIDE_PAIRS = 2048, 16, 2048


def ord_small(text: str) -> bool:
    """Whether each symbol of the text fits in a byte."""
    return text.isascii() or max(text) < "Ā"


class _Pair:
    """Two texts; how far they match from given places."""

    def __init__(self, query: str, ref: str, backward: bool = False):
        wide = not (ord_small(query) and ord_small(ref))
        code = (lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) if wide else (lambda t: np.frombuffer(t.encode("latin-1"), np.uint8))
        q, r = code(query), code(ref)
        if backward:
            q, r = q[::-1], r[::-1]
        self.n, self.m = len(q), len(r)
        # Eight symbols at a time; ends are padded with symbols that differ.
        self.q, self.r = (np.concatenate([x.astype(np.uint32), np.full(8, end, np.uint32)]) for x, end in ((q, 0xFFFFFFFF), (r, 0xFFFFFFFE)))
        self.q8, self.r8 = (None, None) if wide else (self._eight(q, 0xFF), self._eight(r, 0xFE))

    @staticmethod
    def _eight(x: np.ndarray, end: int) -> np.ndarray:
        padded = np.concatenate([x, np.full(8, end, np.uint8)])
        return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(x) + 1].copy().view(np.uint64).ravel()

    def slide(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Query places ``i`` on diagonals ``k`` (reference place less query place) moved past all matches."""
        i = i.copy()
        live = np.flatnonzero((i >= 0) & (i < self.n) & (i + k < self.m))
        while len(live) > FEW:
            a = i[live]
            b = a + k[live]
            left = np.minimum(self.n - a, self.m - b)
            if self.q8 is None:
                run, size = (self.q[a] == self.r[b]).astype(np.int64), 1
            else:
                # The first byte that differs; what is beyond a text's end does not count.
                differ = self.q8[a] ^ self.r8[b]
                run, size = np.where(differ == 0, 8, (differ.view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)), 8
            run = np.minimum(run, left)
            i[live] = a + run
            live = live[(run == size) & (left > size)]
        for at in live.tolist():
            i[at] += self._matches(int(i[at]), int(i[at]) + int(k[at]))
        return i

    def _matches(self, i: int, j: int) -> int:
        """How many symbols from query place ``i`` and reference place ``j`` on are the same."""
        done, most, size = 0, min(self.n - i, self.m - j), 64
        while done < most:
            end = min(done + size, most)
            differ = self.q[i + done : i + end] != self.r[j + done : j + end]
            at = int(differ.argmax())
            if differ[at]:
                return done + at
            done, size = end, size * 4
        return done


def _next(pair: _Pair, low: int, wave: np.ndarray) -> tuple[int, np.ndarray]:
    """The wave of one more edit; a wave's first diagonal is ``low``."""
    padded = np.concatenate([[FAR, FAR], wave, [FAR, FAR]])
    k = np.arange(low - 1, low + len(wave) + 1)
    i = np.maximum(np.maximum(padded[1:-1] + 1, padded[:-2]), padded[2:] + 1)
    i = np.where((i > pair.n) | (i + k > pair.m), np.minimum(pair.n, pair.m - k), i)
    i = np.where((i < 0) | (i + k < 0), FAR, i)
    inside = np.flatnonzero(i >= 0)
    if not len(inside):
        return low, wave
    first, last = inside[0], inside[-1] + 1
    return low - 1 + int(first), pair.slide(i[first:last], k[first:last])


def path(query: str, ref: str, mode: str = "NW", most: int | None = None) -> Path | None:
    """(edits, reference bases spanned, operations) of the whole query against a prefix of the reference (SHW) or all of it (NW).

    None if it takes more than ``most`` edits.
    """
    pair = _Pair(query, ref)
    n, m = pair.n, pair.m
    waves, low, wave = [], 0, pair.slide(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    while True:
        waves.append((low, wave))
        at = np.flatnonzero(wave >= n)
        if mode == "NW":
            at = at[low + at == m - n]
        if len(at):
            k = low + int(at[0])
            break
        if most is not None and len(waves) > most:
            return None
        low, wave = _next(pair, low, wave)
    return len(waves) - 1, n + k, _back(waves, n, m, k)


def _back(waves: list[tuple[int, np.ndarray | list[int]]], n: int, m: int, k: int) -> Ops:
    """Operations of the path that ends with query place ``n`` on diagonal ``k`` of the last wave; ``m`` is the reference's length."""
    i, ops = n, []
    for low, wave in waves[-2::-1]:
        at, size, best = k - low, len(wave), -1
        # Of equal places a substitution before a deletion before an insertion.
        if 0 <= at < size and best < (began := int(wave[at]) + 1) <= i and began + k <= m:
            best, op = began, "X"
        if 0 < at <= size and best < (began := int(wave[at - 1])) <= i and began + k <= m:
            best, op = began, "D"
        if -1 <= at < size - 1 and best < (began := int(wave[at + 1]) + 1) <= i and began + k <= m:
            best, op = began, "I"
        ops += [(i - best, "="), (1, op)]
        i, k = best - (op != "D"), k - (op == "D") + (op == "I")
    ops.append((i, "="))
    return joined(ops[::-1])


class Ask(NamedTuple):
    """A call of ``path`` that a chain waits for."""

    query: str
    ref: str
    mode: str
    most: int | None


Steps = Generator[Part | Ask, Path | None, None]


def paths(asks: list[Ask]) -> list[Path | None]:
    """``path`` of each, the same results: waves of many short pairs are rows of one array, so a pair takes no array operations of its own."""
    found: list[Path | None] = [None] * len(asks)
    small = [k for k, a in enumerate(asks) if max(len(a.query), len(a.ref)) <= SIDE_LENGTH and (a.most is None or a.most > SIDE_EDITS) and ord_small(a.query + a.ref + " ")]
    alone = set(range(len(asks))) - set(small)
    for at in range(0, len(small), SIDE_PAIRS):
        some = small[at : at + SIDE_PAIRS]
        for k, one in zip(some, _side_by_side([asks[k] for k in some]), strict=True):
            if one is None:
                alone.add(k)
            else:
                found[k] = one
    for k in alone:
        found[k] = path(*asks[k])
    return found


def _laid_out(texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight symbols from each place of all texts, one after another with eight ``end`` behind each; where each text begins, and its length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer((end * 8).join([*(t.encode("latin-1") for t in texts), b""]) + end * 8, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(x, 8).copy().view(np.uint64).ravel(), np.concatenate([[0], np.cumsum(sizes + 8)[:-1]]), sizes


def _side_by_side(asks: list[Ask]) -> list[Path | None]:
    """Paths of at most SIDE_EDITS edits, None for others. Row for pair, column for diagonal; pairs that are done leave."""
    q8, q_from, n = _laid_out([a.query for a in asks], b"\xff")
    r8, r_from, m = _laid_out([a.ref for a in asks], b"\xfe")
    whole = np.array([a.mode == "NW" for a in asks])
    found: list[Path | None] = [None] * len(asks)
    live, waves = np.arange(len(asks)), []
    wave, k = np.zeros((len(asks), 1), np.int64), np.zeros(1, np.int64)
    for edits in range(SIDE_EDITS + 1):
        if edits:
            k = np.arange(-edits, edits + 1)
            padded = np.pad(waves[-1], ((0, 0), (2, 2)), constant_values=FAR)
            wave = np.maximum(np.maximum(padded[:, 1:-1] + 1, padded[:, :-2]), padded[:, 2:] + 1)
            wave = np.where((wave > n[live, None]) | (wave + k > m[live, None]), np.minimum(n[live, None], m[live, None] - k), wave)
            wave = np.where((wave < 0) | (wave + k < 0), FAR, wave)
        row, at = np.nonzero((wave >= 0) & (wave < n[live, None]) & (wave + k < m[live, None]))
        i, pair = wave[row, at], live[row]
        a, b, left = q_from[pair] + i, r_from[pair] + i + k[at], np.minimum(n[pair] - i, m[pair] - i - k[at])
        going, moved = np.arange(len(row)), np.zeros(len(row), np.int64)
        while len(going):
            differ = q8[a[going] + moved[going]] ^ r8[b[going] + moved[going]]
            # Bytes before the lowest one that differs.
            lowest = differ & (~differ + np.uint64(1))
            run = np.where(differ == 0, 8, (np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64)) >> 3)
            moved[going] += np.minimum(run, left[going] - moved[going])
            going = going[(run == 8) & (left[going] > moved[going])]
        wave[row, at] = i + moved
        waves.append(wave)
        ended = wave >= n[live, None]
        ended &= ~whole[live, None] | (k == (m - n)[live, None])
        done = ended.any(axis=1)
        if done.any():
            rows = np.flatnonzero(done)
            first = k[ended[rows].argmax(axis=1)].tolist()
            taken = [w[rows].tolist() for w in waves]
            for x, (pair, end) in enumerate(zip(live[rows].tolist(), first, strict=True)):
                size, far = len(asks[pair].query), len(asks[pair].ref)
                found[pair] = edits, size + end, _back([(-d, w[x]) for d, w in enumerate(taken)], size, far, end)
            live, waves = live[~done], [w[~done] for w in waves]
            if not len(live):
                break
    return found


def infix(query: str, ref: str) -> tuple[int, int, Ops]:
    """(edits, start, operations) of the whole query anywhere in the reference: the first end, then the farthest start."""
    pair = _Pair(query, ref)
    k = np.arange(0, pair.m + 1)
    low, wave, edits = 0, pair.slide(np.zeros(len(k), dtype=np.int64), k), 0
    while not (wave >= pair.n).any():
        low, wave = _next(pair, low, wave)
        edits += 1
    end = pair.n + low + int(np.flatnonzero(wave >= pair.n)[0])
    back = _Pair(query, ref[:end], backward=True)
    low, wave = 0, back.slide(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    for _ in range(edits):
        low, wave = _next(back, low, wave)
    start = end - (back.n + low + int(np.flatnonzero(wave >= back.n)[-1]))
    return edits, start, path(query, ref[start:end], "NW")[2]


def joined(ops: Ops) -> Ops:
    out: Ops = []
    for n, op in ops:
        if n and out and out[-1][1] == op:
            out[-1] = (out[-1][0] + n, op)
        elif n:
            out.append((n, op))
    return out


def cigar(ops: Ops) -> str:
    return "".join(f"{n}{op}" for n, op in ops)


def consumed(ops: Ops, kinds: str) -> int:
    return sum(n for n, op in ops if op in kinds)


def ending_with_match(ops: Ops, least: int = 1) -> Ops:
    """Without what follows the last run of at least ``least`` matches; empty if there is none."""
    for at in range(len(ops) - 1, -1, -1):
        if ops[at][1] == "=" and ops[at][0] >= least:
            return ops[: at + 1]
    return []


def _advance(run: Steps, answer: Path | None = None) -> Part | Ask | None:
    """The next part or question of a chain after ``answer``; None at its end."""
    try:
        return run.send(answer)
    except StopIteration:
        return None


def chains(runs: list[Steps]) -> list[list[Part]]:
    """The parts of each chain; all go on together, so that what they ask for is aligned side by side."""
    parts: list[list[Part]] = [[] for _ in runs]
    live: list[tuple[int, Path | None]] = [(k, None) for k in range(len(runs))]
    while live:
        asked = []
        for k, answer in live:
            item = _advance(runs[k], answer)
            while item is not None and not isinstance(item, Ask):
                parts[k].append(item)
                item = _advance(runs[k])
            if item is not None:
                asked.append((k, item))
        live = list(zip([k for k, _ in asked], paths([ask for _, ask in asked]), strict=True))
    return parts


def chain(query: str, ref: str, chunk: int = 100_000, pad: int = 10_000, mode: str = "NW", anchor: int = 1) -> Iterator[Part]:
    """The parts of one chain; see ``steps``."""
    run = steps(query, ref, chunk, pad, mode, anchor)
    item = _advance(run)
    while item is not None:
        if isinstance(item, Ask):
            item = _advance(run, path(*item))
        else:
            yield item
            item = _advance(run)


def steps(query: str, ref: str, chunk: int = 100_000, pad: int = 10_000, mode: str = "NW", anchor: int = 1) -> Steps:
    """(query start, query end, reference start, edits, operations) of consecutive chunks, and between them what to align; each starts with the match that ends the one before.

    Modes: ``NW`` aligns both texts whole, ``HW`` the query whole, anywhere in the reference, ``HWT`` the same with what is before the first
    and after the last match cut off. A chunk's reference is ``pad`` longer than its query. The first chunk may begin anywhere there (HW, HWT).
    ``anchor``: matches in a row that a chunk has to end with, to be safer than one. An empty query gives nothing.
    """
    n, m = len(query), len(ref)
    if n == 0:
        return
    size, q0, r0, first = chunk, 0, 0, True
    while True:
        last = q0 + size + (not first) >= n
        q1 = n if last else q0 + size
        far = m if last else min(m, q1 + pad) if first else min(m, r0 + size + pad)
        if last and first and mode != "NW":
            far = min(m, q1 + pad)
        start = r0
        if first and mode != "NW":
            edits, shift, ops = infix(query[q0:q1], ref[r0:far])
            start = r0 + shift
        elif last and mode == "NW" and (far - r0) - (q1 - q0) <= MOST_EDITS:
            found = yield Ask(query[q0:q1], ref[r0:far], "NW", None if q1 - q0 <= MOST_EDITS else MOST_EDITS)
            if found is None:
                size = (q1 - q0) // 2
                continue
            edits, _, ops = found
        else:
            found = yield Ask(query[q0:q1], ref[r0:far], "SHW", None if q1 - q0 <= MOST_EDITS else MOST_EDITS)
            if found is None:
                size = (q1 - q0) // 2
                continue
            edits, spanned, ops = found
            if last and mode == "NW":
                # What is left of the reference is one long deletion.
                edits, ops = edits + far - r0 - spanned, joined([*ops, (far - r0 - spanned, "D")])
        if first and mode == "HWT":
            skipped = next((k for k, o in enumerate(ops) if o[1] == "="), len(ops))
            q0, start, edits, ops = q0 + consumed(ops[:skipped], "=XI"), start + consumed(ops[:skipped], "=XD"), edits - consumed(ops[:skipped], "XDI"), ops[skipped:]
        if not last or mode == "HWT":
            kept = ending_with_match(ops, anchor if not last else 1) or (ending_with_match(ops) if last else [])
            moved = consumed(kept, "=XI")
            if not last and moved <= (not first):
                # No match to go on from: a longer chunk, or, if it is long enough, this one as it is.
                if size < MOST_EDITS:
                    size *= 2
                    continue
                kept = ops
            edits, ops = edits - consumed(ops[len(kept) :], "XDI"), kept
        used = consumed(ops, "=XI")
        if used or not last:
            yield q0, q0 + used, start, edits, ops
        if last:
            return
        back = 1 if ops[-1][1] == "=" else 0
        q0, r0, first, size = q0 + used - back, start + consumed(ops, "=XD") - back, False, chunk
        if q0 + back >= n:
            return


def variants_of(query: str, ref: str, q0: int, r0: int, ops: Ops) -> Iterator[tuple[int, str, str]]:
    """(pos, ref, alt) of runs of operations that are not matches; an insertion or deletion carries the base before it and is moved left as far as it goes."""
    q, r, at, floor = q0, r0, 0, r0
    while at < len(ops):
        if ops[at][1] == "=":
            # The base before a variant has to be one that both have.
            q, r, at, floor = q + ops[at][0], r + ops[at][0], at + 1, r + 1
            continue
        a, b = q, r
        while at < len(ops) and ops[at][1] != "=":
            n, op = ops[at]
            q, r, at = q + n * (op != "D"), r + n * (op != "I"), at + 1
        old, new, pos = ref[b:r], query[a:q], b
        while old and new and old[-1] == new[-1]:
            old, new = old[:-1], new[:-1]
        if not old or not new:
            text = old or new
            while pos > floor and ref[pos - 1] == text[-1]:
                text, pos = ref[pos - 1] + text[:-1], pos - 1
            old, new = (text, "") if old else ("", text)
            # Without a base before it, the one behind it says where it is.
            before, after = (ref[pos - 1], "") if pos > 0 else ("", ref[pos + len(old) : pos + len(old) + 1])
            old, new, pos = before + old + after, before + new + after, pos - len(before)
        while len(old) > 1 and len(new) > 1 and old[0] == new[0]:
            old, new, pos = old[1:], new[1:], pos + 1
        yield pos, old, new


def word_places(text: str, k: int, one_in: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of ``k`` symbols that are kept: those whose hash is a multiple of ``one_in``, the same ones in any text."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(x) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor, value, size = 0xD1342543DE82EF95, x, 1
    # Words of twice as many symbols from two of half, so a few passes over the text, not one for each symbol of a word.
    for bit in f"{k:b}"[1:]:
        value, size = value[:-size] * np.uint64(pow(factor, size, 1 << 64)) + value[size:], 2 * size
        if bit == "1":
            value, size = value[: len(x) - size] * np.uint64(factor) + x[size:], size + 1
    value ^= value >> np.uint64(31)
    value *= np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    at = np.flatnonzero(value % np.uint64(one_in) == 0)
    return value[at], at


def _anchors(pairs: DataFrame, k: int, one_in: int) -> DataFrame:
    """name, q, r: places of words that occur once in the query and once in the reference, kept where both rise."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # One table for a batch: a table for each text costs more than its words.
            found = [word_places(text, k, one_in) for text in batch.text]
            sizes = [len(places) for _, places in found]
            if sum(sizes):
                hashes, places = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"name": np.repeat(batch.name.to_numpy(), sizes), "side": np.repeat(batch.side.to_numpy(), sizes), "word": hashes.view(np.int64), "at": places})

    kind = dict(pairs.dtypes)["name"]
    sides = pairs.select("name", F.lit("q").alias("side"), F.col("query").alias("text")).unionByName(pairs.select("name", F.lit("r").alias("side"), F.col("ref").alias("text")))
    found = sides.mapInPandas(words, f"name {kind}, side string, word long, at long")
    in_side = lambda s: F.col("side") == s
    once = found.groupBy("name", "word").agg(
        F.count_if(in_side("q")).alias("nq"), F.count_if(in_side("r")).alias("nr"), F.max(F.when(in_side("q"), F.col("at"))).alias("q"), F.max(F.when(in_side("r"), F.col("at"))).alias("r")
    )
    once = once.where("nq = 1 and nr = 1")
    rising = W.partitionBy("name").orderBy("q")
    held = once.withColumn("high", F.max("r").over(rising.rowsBetween(W.unboundedPreceding, -1))).withColumn("low", F.min("r").over(rising.rowsBetween(1, W.unboundedFollowing)))
    return held.where("(high is null or high < r) and (low is null or low > r)").select("name", "q", "r")


def pieces(pairs: DataFrame, piece: int = 100_000, k: int = 32, one_in: int = 64) -> DataFrame:
    """name, piece, q0, q1, r0, r1, query, ref: pairs cut at anchors about every ``piece`` symbols, with one symbol in common; short pairs are one piece.

    Texts are put together from windows, so after the words are found no row has a whole contig unless nothing anchors it.
    """
    lengths = pairs.select("name", F.length("query").cast("long").alias("n"), F.length("ref").cast("long").alias("m"))
    long = pairs.where(F.length("query") > piece)
    cuts = _anchors(long, k, one_in).groupBy("name", F.floor(F.col("q") / piece).alias("b")).agg(F.min(F.struct("q", "r")).alias("c")).where("b > 0").select("name", "c.q", "c.r")
    starts = lengths.select("name", F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("r")).unionByName(cuts)
    order = W.partitionBy("name").orderBy("q")
    spans = starts.withColumn("q1", F.lead("q").over(order) + 1).withColumn("r1", F.lead("r").over(order) + 1).withColumn("piece", F.row_number().over(order) - 1)
    spans = spans.join(lengths, "name").select("name", "piece", F.col("q").alias("q0"), F.coalesce("q1", "n").alias("q1"), F.col("r").alias("r0"), F.coalesce("r1", "m").alias("r1"), F.col("q1").isNull().alias("last"))
    one = spans.where("last and piece = 0").join(pairs.select("name", "query", "ref"), "name")
    several = spans.where("not last or piece > 0")
    for side, low, high in (("query", "q0", "q1"), ("ref", "r0", "r1")):
        several = slices(several, windowed(long, "name", side, WIDTH), "name", low, high, side)
    return one.unionByName(several.select(*one.columns))


RESULT = "piece int, part int, q_start long, q_end long, start long, edits long, cigar string"


def align_long(pairs: DataFrame, mode: str = "NW", chunk: int = 100_000, pad: int = 10_000, piece: int = 100_000, anchor: int = 1, with_variants: bool = False) -> DataFrame:
    """name, piece, part, q_start, q_end, start, edits, cigar of pairs (name, query, ref), one row a chunk; ``with_variants``: also ``variants``, an array of pos, ref, alt.

    Consecutive chunks have one match in common. A null text is empty; an empty query gives no row, as nothing of it aligns; an empty
    reference makes it one insertion. Names are unique.
    """
    if mode not in ("NW", "HW", "HWT"):
        raise KeyError(f"mode {mode} is not one of NW, HW, HWT")
    ship(pairs.sparkSession)
    empty = F.lit("")
    rows = pairs.select("name", F.coalesce("query", empty).alias("query"), F.coalesce("ref", empty).alias("ref"))
    kind = dict(rows.dtypes)["name"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (rows for batch in batches for rows in _some(batch.itertuples(index=False))):
            out, runs = [], []
            for row in rows:
                first, last = row.piece == 0, row.last
                ends = {"NW": "NW", "HW": "HW" if first else "SHW", "HWT": "HWT" if first else "SHWT"}[mode] if last else {"NW": "NW", "HW": "HW", "HWT": "HWT"}[mode] if first else "NW"
                runs.append(_ends(row.query, row.ref, chunk, pad, ends, anchor))
            for row, parts in zip(rows, chains(runs), strict=True):
                for part, (q0, q1, start, edits, ops) in enumerate(parts):
                    found = [(row.r0 + pos, old, new) for pos, old, new in variants_of(row.query, row.ref, q0, start, ops)] if with_variants else []
                    out.append((row.name, row.piece, part, row.q0 + q0, row.q0 + q1, row.r0 + start, edits, cigar(ops), [{"pos": p, "ref": o, "alt": a} for p, o, a in found]))
            frame = pd.DataFrame(out, columns=["name", "piece", "part", "q_start", "q_end", "start", "edits", "cigar", "variants"])
            yield frame if with_variants else frame.drop(columns="variants")

    schema = f"name {kind}, {RESULT}" + (", variants array<struct<pos: bigint, ref: string, alt: string>>" if with_variants else "")
    return spread(pieces(rows, piece), "name", "piece").mapInPandas(run, schema)


def _some(rows: Iterator) -> Iterator[list]:
    """Rows in lists of at most SIDE_PAIRS."""
    while some := list(islice(rows, SIDE_PAIRS)):
        yield some


def _ends(query: str, ref: str, chunk: int, pad: int, mode: str, anchor: int) -> Steps:
    """``steps`` for a piece: one that others follow (HW, HWT) ends where the reference does, one after others (SHW, SHWT) begins where it does."""
    if mode not in ("SHW", "SHWT"):
        yield from steps(query, ref, chunk, pad, mode, anchor)
        return
    # Free at its end only: as a global alignment without the reference's rest.
    run, answer = steps(query, ref, chunk, pad, "NW", anchor), None
    while (item := _advance(run, answer)) is not None:
        if isinstance(item, Ask):
            answer = yield item
            continue
        answer, (q0, q1, start, edits, ops) = None, item
        if q1 == len(query):
            tail = len(ops) and ops[-1][1] == "D"
            edits, ops = edits - ops[-1][0] * tail, ops[:-1] if tail else ops
            if mode == "SHWT":
                kept = ending_with_match(ops)
                q1, edits, ops = q1 - consumed(ops[len(kept) :], "=XI"), edits - consumed(ops[len(kept) :], "XDI"), kept
        yield q0, q1, start, edits, ops
