"""Greedy word-piece token counts with a linear longest-match automaton.

The vocabulary is a trie over bytes. A node's failure link leads to the node
that remains when the longest vocabulary pieces at its start are popped, and the number
of popped pieces is computed once, so a word is read byte by byte, never again, and
its number of pieces is a sum; no piece is built. Words repeat, so counts are
kept by word in a cache of bounded size.
"""

from __future__ import annotations

import base64
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_or_empty

#: Runs of letters, digits or other marks, each with one blank before it if there is one; else white space.
WORD = re.compile(r" ?[^\W\d_]+| ?\d+| ?[^\s\w]+| ?_+|\s+")
CACHE = 200_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Trie, failure links and popped counts of a vocabulary. A word that the vocabulary cannot cover counts as one unknown piece."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.step: dict[int, int] = {}
        self.fail, self.popped = [-1], [0]
        whole = [False]
        parent: list[tuple[int, int]] = [(-1, -1)]
        for piece in sorted(set(vocabulary)):
            if not piece:
                continue
            node = 0
            for byte in piece:
                key = node << 8 | byte
                to = self.step.get(key)
                if to is None:
                    to = self.step[key] = len(whole)
                    whole.append(False)
                    parent.append((node, byte))
                node = to
            whole[node] = True
        children: dict[int, list[int]] = {}
        for node in range(1, len(whole)):
            children.setdefault(parent[node][0], []).append(node)
        self.fail = [-1] * len(whole)
        self.popped = [0] * len(whole)
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for node in children.get(above, ()):
                queue.append(node)
                if whole[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                z, count = self.fail[above], self.popped[above]
                while z >= 0 and (z << 8 | parent[node][1]) not in self.step:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.step[z << 8 | parent[node][1]], count
        self.cache: dict[str, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of one word."""
        step, fail, popped = self.step, self.fail, self.popped
        node = total = 0
        for byte in word:
            to = step.get(node << 8 | byte)
            while to is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = step.get(node << 8 | byte)
            node = to
        while node:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return total

    def count_text(self, text: str) -> tuple[int, int]:
        """Words and pieces of a text."""
        words = WORD.findall(text)
        pieces, cache = 0, self.cache
        for word, often in Counter(words).items():
            n = cache.get(word)
            if n is None:
                n = self.count(word.encode("utf-8", "replace"))
                if len(word) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = n
            pieces += n * often
        return len(words), pieces


def count_tokens(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens: one row per row of ``docs``; null text is empty and has 0 of each."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in batches:
            counts = [automaton.count_text(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]],
                names=["doc_id", "n_bytes", "n_words", "n_tokens"],
            )

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return map_batches(rows, run, "doc_id long, n_bytes long, n_words long, n_tokens long")
