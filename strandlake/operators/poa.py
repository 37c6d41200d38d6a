"""Partial-order alignment: sub-reads of a molecule in one graph of bases, its heaviest path, and two alleles told apart by its columns.

A node is a base; bases that were aligned to each other and differ share a column. A sequence is aligned to the graph by dynamic
programming in topological order, one row of numpy operations a node. An edge counts the reads that take it; the consensus is the path
from begin to end whose edges have most reads, each less half of all, so that a stretch few reads have is not taken for its length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import compress_homopolymers
from ..session import ship

#: Scores of the graph aligner.
MATCH, MISMATCH, GAP = 5, -4, -8
#: Sub-reads that one graph takes; larger groups are a tree of such graphs.
GROUP = 64


class Graph:
    """``before[v]``: what precedes node v, with the reads that go there; -1 is the begin. ``ends``: reads that end at a node."""

    def __init__(self) -> None:
        self.base: list[str] = []
        self.column: list[int] = []
        self.before: list[dict[int, int]] = []
        self.ends: Counter = Counter()
        self.columns: list[dict[str, int]] = []
        self.order: list[int] = []
        self.paths: list[list[int]] = []
        self.total = 0

    def node(self, base: str, column: int | None = None) -> int:
        if column is None:
            column = len(self.columns)
            self.columns.append({})
        self.columns[column][base] = len(self.base)
        self.base.append(base)
        self.column.append(column)
        self.before.append({})
        return len(self.base) - 1

    def add(self, seq: str, weight: int = 1) -> None:
        """Align a sequence and thread it through the graph, as ``weight`` reads."""
        pairs = self._aligned(seq) if self.base else [(None, k) for k in range(len(seq))]
        last, path = -1, []
        for node, k in pairs:
            if k is None:
                continue
            if node is None:
                node = self.node(seq[k])
            elif self.base[node] != seq[k]:
                column = self.column[node]
                other = self.columns[column].get(seq[k])
                node = self.node(seq[k], column) if other is None else other
            self.before[node][last] = self.before[node].get(last, 0) + weight
            path.append(node)
            last = node
        self.ends[last] += weight
        self.paths.append(path)
        self.total += weight
        self._sort()

    def _sort(self) -> None:
        """Nodes after all that precede them."""
        after: list[list[int]] = [[] for _ in self.base]
        waits = [0] * len(self.base)
        for v, before in enumerate(self.before):
            for u in before:
                if u >= 0:
                    after[u].append(v)
                    waits[v] += 1
        ready = [v for v in range(len(self.base) - 1, -1, -1) if not waits[v]]
        self.order = []
        while ready:
            v = ready.pop()
            self.order.append(v)
            for x in reversed(after[v]):
                waits[x] -= 1
                if not waits[x]:
                    ready.append(x)

    def _aligned(self, seq: str) -> list[tuple[int | None, int | None]]:
        """(node, place in the sequence) in order, None where one has nothing; all of the sequence against a whole path."""
        n = len(seq)
        codes, steps = np.array([ord(c) for c in seq], dtype=np.int64), np.arange(n + 1, dtype=np.int64) * GAP
        rows: dict[int, np.ndarray] = {-1: steps}
        for v in self.order:
            score = np.where(codes == ord(self.base[v]), MATCH, MISMATCH)
            best = None
            for u in self.before[v]:
                row = rows[u] + GAP
                row[1:] = np.maximum(row[1:], rows[u][:-1] + score)
                best = row if best is None else np.maximum(best, row)
            # Bases of the sequence alone: the best start to the left, less a gap for each.
            rows[v] = np.maximum.accumulate(best - steps) + steps
        v = max(self.ends, key=lambda u: (rows[u][n], -u))
        k, out = n, []
        while v >= 0 or k > 0:
            if v < 0:
                k -= 1
                out.append((None, k))
                continue
            here = rows[v][k]
            found = next((u for u in self.before[v] if k > 0 and here == rows[u][k - 1] + (MATCH if seq[k - 1] == self.base[v] else MISMATCH)), None)
            if found is not None:
                k -= 1
                out.append((v, k))
                v = found
                continue
            found = next((u for u in self.before[v] if here == rows[u][k] + GAP), None)
            if found is not None:
                out.append((v, None))
                v = found
            else:
                k -= 1
                out.append((None, k))
        return out[::-1]

    def consensus(self) -> str:
        score, come = {-1: 0.0}, {}
        for v in self.order:
            score[v], _, come[v] = max((score[u] + w - self.total / 2, -u, u) for u, w in self.before[v].items())
        v = max(self.ends, key=lambda u: (score[u] + self.ends[u] - self.total / 2, -u), default=-1)
        out = []
        while v >= 0:
            out.append(self.base[v])
            v = come[v]
        return "".join(out[::-1])

    def table(self) -> list[list[str]]:
        """Of each sequence, its base in each column of the graph, ``-`` where it has none."""
        rows = []
        for path in self.paths:
            row = ["-"] * len(self.columns)
            for v in path:
                row[self.column[v]] = self.base[v]
            rows.append(row)
        return rows


def consensus(seqs: list[str], weights: list[int] | None = None) -> str:
    """Consensus of sequences, longest first; of more than two, once more with the first result as the graph to begin with."""
    pairs = sorted(((s, w) for s, w in zip(seqs, weights or [1] * len(seqs), strict=True) if s), key=lambda p: (-len(p[0]), p[0]))
    if not pairs:
        return ""
    first = None
    for _ in range(1 + (len(pairs) > 2)):
        graph = Graph()
        if first:
            graph.add(first, 0)
        for seq, weight in pairs:
            graph.add(seq, weight)
        first = graph.consensus()
    return first


def molecule_consensus(subreads: DataFrame, keys: list[str], group: int = GROUP) -> DataFrame:
    """keys, seq: consensus of each group's sub-reads (column seq). Nulls and empty sequences count for nothing; a group of these alone gives none.

    Equal sequences are one with a weight. Groups of more than ``group`` sequences become a tree: consensus of some, then of these.
    """
    ship(subreads.sparkSession)
    fields = ", ".join(f"{c} {t}" for c, t in subreads.dtypes if c in keys)
    rows = subreads.where("seq <> ''").groupBy(*keys, "seq").agg(F.count(F.lit(1)).alias("weight"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        seq = consensus(list(part.seq), [int(w) for w in part.weight])
        return pd.DataFrame([[*(part[c].iloc[0] for c in keys), seq, int(part.weight.sum())]], columns=[*keys, "seq", "weight"])

    most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.length("seq")), "seq")) - 1
        rows = rows.withColumn("_slot", F.floor(place / group)).groupBy(*keys, "_slot").applyInPandas(run, f"{fields}, seq string, weight long")
        most = -(-most // group)
        if most <= 1:
            return rows.select(*keys, "seq")


def two_alleles(seqs: list[str], weights: list[int], least: float = 0.3) -> list[int]:
    """The cluster, 1 or 2, of each sequence: by the columns of their graph in which a second symbol has at least ``least`` of the reads.

    Clusters begin with the two sequences that differ most there, and take in the nearer ones until nothing moves. A smaller cluster
    with less than ``least`` of the reads is none. Cluster 1 has more reads, or the first sequence in order.
    """
    graph = Graph()
    for k in sorted(range(len(seqs)), key=lambda k: (-len(seqs[k]), seqs[k], k)):
        graph.add(seqs[k], weights[k])
    table = dict(zip(sorted(range(len(seqs)), key=lambda k: (-len(seqs[k]), seqs[k], k)), graph.table(), strict=True))
    total = sum(weights)
    split = []
    for c in range(len(graph.columns)):
        count: Counter = Counter()
        for k, row in table.items():
            count[row[c]] += weights[k]
        if len(count) > 1 and count.most_common(2)[1][1] >= least * total:
            split.append(c)
    marks = {k: tuple(row[c] for c in split) for k, row in table.items()}
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    kinds = sorted(set(marks.values()))
    if len(kinds) < 2:
        return [1] * len(seqs)
    # The commonest marks, and those farthest from them.
    often: Counter = Counter()
    for k, mark in marks.items():
        often[mark] += weights[k]
    one = max(kinds, key=lambda m: (often[m], m))
    two = max(kinds, key=lambda m: (apart(one, m), often[m], m))
    for _ in range(20):
        near = {m: 1 if apart(m, one) <= apart(m, two) else 2 for m in kinds}
        middle = []
        for side in (1, 2):
            votes = [Counter() for _ in split]
            for k, mark in marks.items():
                if near[mark] == side:
                    for v, symbol in zip(votes, mark, strict=True):
                        v[symbol] += weights[k]
            middle.append(tuple(max(sorted(v), key=v.get) if v else "-" for v in votes))
        if middle == [one, two]:
            break
        one, two = middle
    own = [near[marks[k]] for k in range(len(seqs))]
    sizes = {side: sum(w for c, w in zip(own, weights, strict=True) if c == side) for side in (1, 2)}
    if min(sizes.values()) < least * total:
        return [1] * len(seqs)
    lead = max((1, 2), key=lambda side: (sizes[side], [-ord(ch) for ch in min(s for s, c in zip(seqs, own, strict=True) if c == side)]))
    return [1 if c == lead else 2 for c in own]


def sequence_clusters(reads: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """``reads`` (keys, seq, ...) with cluster, 1 or 2, by the sequence of their homopolymer runs, so that alleles of equal length are told apart.

    Equal run sequences are one with a weight. A null or empty sequence is in cluster 1. A region has as many reads as its depth.
    """
    ship(reads.sparkSession)
    fields = ", ".join(f"{c} {t}" for c, t in reads.dtypes if c in keys)
    squeezed = reads.withColumn("_runs", F.coalesce(compress_homopolymers(F.col("seq"))["seq"], F.lit("")))
    kinds = squeezed.where("_runs <> ''").groupBy(*keys, "_runs").agg(F.count(F.lit(1)).alias("weight"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_runs")
        return part[[*keys, "_runs"]].assign(cluster=two_alleles(list(part._runs), [int(w) for w in part.weight], least))

    told = kinds.groupBy(*keys).applyInPandas(run, f"{fields}, _runs string, cluster int")
    return squeezed.join(told, [*keys, "_runs"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(1))).drop("_runs")
