"""Pairwise alignment as Arrow functions: affine gaps, global, local or semi-global. Ties: diagonal, then deletion, then insertion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Scores of the local aligner.
MATCH, MISMATCH, OPEN, EXTEND = 5, -4, 5, 3
RESULT = "score int, start int, cigar string"


#: Cells of the tables that are made at once for several queries of one reference.
CELLS = 1 << 23


def _tables(queries: list[str], ref: str, mode: str, match: int, mismatch: int, gap_open: int, gap_extend: int) -> tuple:
    """Best scores (h), and those that end in a deletion (d) or an insertion (i); first axis query bases, then queries, then reference bases.

    One row of all queries is made at a time, vectorised; what is beyond a shorter query's end is not its own.
    """
    qs, r = [np.frombuffer(q.encode(), np.uint8) for q in queries], np.frombuffer(ref.encode(), np.uint8)
    n, m = max(map(len, qs)), len(r)
    padded = np.zeros((n, len(qs)), np.uint8)
    for k, q in enumerate(qs):
        padded[: len(q), k] = q
    # No score is as far from 0 as this; where it is small, so are the tables.
    small = max(abs(match), abs(mismatch), abs(gap_extend)) * (n + m) + 2 * abs(gap_open) < 15_000
    kind, low = (np.int16, -20_000) if small else (np.int32, -(10**8))
    h, d, i = np.empty((3, n + 1, len(qs), m + 1), kind)
    steps = np.arange(m + 1, dtype=kind) * kind(gap_extend)
    h[0], d[0], i[0], d[:, :, 0] = low, low, low, low
    h[0, :, 0] = 0
    h[0, :, 1:] = 0 if mode in ("local", "infix") else -(gap_open + steps[:-1])
    if mode == "global":
        d[0, :, 1:] = h[0, :, 1:]
    back = steps[:-1] + gap_open
    # What a reference base scores against each symbol of the queries.
    scores = {int(c): np.where(r == c, match, mismatch).astype(kind) for c in np.unique(padded)}
    for k in range(1, n + 1):
        np.maximum(h[k - 1] - gap_open, i[k - 1] - gap_extend, out=i[k])
        if mode == "local":
            i[k, :, 0] = low
        best = h[k]
        best[:, 0] = 0 if mode == "local" else i[k, :, 0]
        for b, c in enumerate(padded[k - 1].tolist()):
            np.add(h[k - 1, b, :-1], scores[c], out=best[b, 1:])
        np.maximum(best[:, 1:], i[k, :, 1:], out=best[:, 1:])
        if mode == "local":
            np.maximum(best, 0, out=best)
        # A deletion of any length: the best start to its left, less its cost, is a running maximum.
        np.subtract(np.maximum.accumulate(best + steps, axis=1)[:, :-1], back, out=d[k, :, 1:])
        np.maximum(best[:, 1:], d[k, :, 1:], out=best[:, 1:])
    return h, d, i, qs, r


def align_pair(query: str, ref: str, mode: str = "local", match: int = MATCH, mismatch: int = MISMATCH, gap_open: int = OPEN, gap_extend: int = EXTEND) -> tuple[int, int, str]:
    """Score, first reference base and CIGAR (= X I D, soft clips if local). ``infix``: the whole query anywhere in the reference."""
    if not query or not ref:
        cigar = f"{len(ref)}D" if ref and mode == "global" else f"{len(query)}S" if query and mode == "local" else f"{len(query)}I" if query else ""
        cost = len(query) + len(ref)
        return (0 if mode == "local" or not cost or (mode == "infix" and not query) else -(gap_open + (cost - 1) * gap_extend)), 0, cigar
    h, d, i, (q,), r = _tables([query], ref, mode, match, mismatch, gap_open, gap_extend)
    return _traced(h[:, 0], d[:, 0], i[:, 0], q, r, mode, match, mismatch, gap_open, gap_extend)


def align_all(queries: list[str], ref: str) -> list[str]:
    """CIGARs of ``align_pair``, global, of several queries against one reference, whose tables are made together; equal queries are aligned once."""
    # Against itself each base matches, as any gap costs and wins nothing.
    found = {q: f"{len(ref.encode())}=" if q == ref and q else None for q in queries}
    rest = sorted((q for q, c in found.items() if c is None), key=len, reverse=True)
    while rest:
        if not rest[0] or not ref:
            found[rest[0]], rest = align_pair(rest[0], ref, "global")[2], rest[1:]
            continue
        size = max(1, CELLS // ((len(rest[0].encode()) + 1) * (len(ref.encode()) + 1)))
        part, rest = rest[:size], rest[size:]
        part, rest = [q for q in part if q], [q for q in part if not q] + rest
        h, d, i, qs, r = _tables(part, ref, "global", MATCH, MISMATCH, OPEN, EXTEND)
        for k, q in enumerate(part):
            found[q] = _traced(h[:, k], d[:, k], i[:, k], qs[k], r, "global", MATCH, MISMATCH, OPEN, EXTEND)[2]
    return [found[q] for q in queries]


def _traced(h: np.ndarray, d: np.ndarray, i: np.ndarray, q: np.ndarray, r: np.ndarray, mode: str, match: int, mismatch: int, gap_open: int, gap_extend: int) -> tuple[int, int, str]:
    """``align_pair``'s result from the tables of a pair."""
    if mode == "global":
        x, y = len(q), len(r)
    elif mode == "infix":
        x, y = len(q), int(np.argmax(h[len(q)]))
    else:
        x, y = map(int, np.unravel_index(np.argmax(h), h.shape))
    score, end = int(h[x, y]), x
    ops: list[str] = []
    state = "h"
    while x > 0 or y > 0:
        if mode == "local" and state == "h" and h[x, y] == 0 or mode == "infix" and x == 0:
            break
        if state == "h":
            if x > 0 and y > 0 and h[x, y] == h[x - 1, y - 1] + (match if q[x - 1] == r[y - 1] else mismatch):
                ops.append("=" if q[x - 1] == r[y - 1] else "X")
                x, y = x - 1, y - 1
            else:
                state = "d" if y > 0 and h[x, y] == d[x, y] else "i"
        elif state == "d":
            ops.append("D")
            y -= 1
            state = "d" if y > 0 and d[x, y + 1] == d[x, y] - gap_extend and d[x, y + 1] != h[x, y] - gap_open else "h"
        else:
            ops.append("I")
            x -= 1
            state = "i" if x > 0 and i[x + 1, y] == i[x, y] - gap_extend and i[x + 1, y] != h[x, y] - gap_open else "h"
    body, runs = ops[::-1], []
    for op in body:
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    cigar = "".join(f"{k}{op}" for k, op in runs)
    if mode == "local":
        cigar = (f"{x}S" if x else "") + cigar + (f"{len(q) - end}S" if end < len(q) else "")
    return score, y, cigar


def align(query: Column, ref: Column, mode: str = "local", match: int = MATCH, mismatch: int = MISMATCH, gap_open: int = OPEN, gap_extend: int = EXTEND) -> Column:
    """struct<score, start, cigar> of two string columns; null if either is."""

    @F.pandas_udf(RESULT)
    def run(queries: pd.Series, refs: pd.Series) -> pd.DataFrame:
        rows = [
            (None, None, None) if q is None or r is None else align_pair(q, r, mode, match, mismatch, gap_open, gap_extend)
            for q, r in zip(queries, refs, strict=True)
        ]
        return pd.DataFrame(rows, columns=["score", "start", "cigar"]).astype({"score": "Int32", "start": "Int32"})

    return run(query, ref)


def orient(subreads: DataFrame, template: str = "template") -> DataFrame:
    """Sub-reads with is_rev: the strand that aligns better to ``template``; ties go to reverse. seq is turned."""
    from ..functions.sequences import reverse_complement

    both = subreads.withColumn("_f", align(F.col("seq"), F.col(template))["score"]).withColumn("_r", align(reverse_complement(F.col("seq")), F.col(template))["score"])
    turned = both.withColumn("is_rev", ~(F.col("_f") > F.col("_r")))
    return turned.withColumn("seq", F.when(F.col("is_rev"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).drop("_f", "_r")


def best_alleles(reads: DataFrame, alleles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, is_rev, allele, n, score: reads by their best allele (seq against alleles' hap); reads all of whose alleles score alike count for allele -1."""
    scored = reads.join(alleles, keys).withColumn("_score", align(F.col("seq"), F.col("hap"))["score"])
    best = scored.groupBy(*keys, "read_id", "is_rev").agg(
        F.max("_score").alias("_top"), F.min("_score").alias("_low"), F.count(F.lit(1)).alias("_n"), F.min(F.struct(-F.col("_score"), "allele")).alias("_best")
    )
    allele = F.when((F.col("_top") == F.col("_low")) & (F.col("_n") > 1), F.lit(-1)).otherwise(F.col("_best.allele"))
    return best.groupBy(*keys, "is_rev", allele.alias("allele")).agg(F.count(F.lit(1)).alias("n"), F.sum("_top").cast("long").alias("score"))


def star_consensus(subreads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq: majority consensus of sub-reads aligned to one of them, of median length. A group is one molecule's sub-reads, so it is small."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.seq, key=lambda s: (len(s), s))
        centre = rows[(len(rows) - 1) // 2]
        columns = [{} for _ in range(len(centre))]
        inserted: list[dict] = [{} for _ in range(len(centre) + 1)]
        for s, cigar in zip(rows, align_all(rows, centre), strict=True):
            at, x, extra, number = 0, 0, {}, ""
            for c in cigar:
                if c.isdigit():
                    number += c
                    continue
                k, number = int(number), ""
                for _ in range(k):
                    if c == "I":
                        extra[at] = extra.get(at, "") + s[x]
                        x += 1
                    elif c == "D":
                        columns[at]["*"] = columns[at].get("*", 0) + 1
                        at += 1
                    else:
                        columns[at][s[x]] = columns[at].get(s[x], 0) + 1
                        x, at = x + 1, at + 1
            for place, text in extra.items():
                inserted[place][text] = inserted[place].get(text, 0) + 1
        out = []
        for k in range(len(centre) + 1):
            for text, n in sorted(inserted[k].items(), key=lambda e: (-e[1], e[0]))[:1]:
                if 2 * n > len(rows):
                    out.append(text)
            if k < len(centre):
                out.append(max(sorted(columns[k].items()), key=lambda e: e[1])[0])
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in keys), "".join(out).replace("*", "")]], columns=[*keys, "seq"])

    fields = ", ".join(f"{c} {t}" for c, t in subreads.dtypes if c in keys)
    return spread(subreads, *keys).groupBy(*keys).applyInPandas(run, f"{fields}, seq string")


def align_to_reference(query: Column, ref: Column) -> Column:
    """Global alignment with a gap of open 8 and extend 4; an empty query is one deletion."""
    return align(query, ref, "global", gap_open=8, gap_extend=4)
