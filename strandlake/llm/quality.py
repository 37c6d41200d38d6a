"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions, of rank ``RANK``, in time linear in the features. It is fitted by
mini-batch Adam on the driver from a bounded sample of labelled rows, of which only
features leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, fresh, map_batches
from .sampling import labelled_sample
from .textbatch import Block, Words, blocks, row_counts, words

BUCKETS, RANK = 1 << 13, 8
#: At most so many labelled rows are used for fitting.
TRAIN_ROWS = 4000
CUT = 0.7
MARKS = b"!?*#$%&@|<>{}[]()/\\=_~^-.,;:\"'"
STATS = 22


def statistics(block: Block, found: Words, n_chars: np.ndarray) -> np.ndarray:
    """(rows, STATS) structure statistics of texts; ``n_chars`` is the metadata column."""
    data, offsets = block.data, block.offsets
    n = len(block)
    total = np.maximum(np.diff(offsets), 1).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / total

    counts = found.counts
    n_words = np.maximum(counts, 1).astype(np.float64)
    lengths = found.ends - found.starts
    row = found.row
    same = np.zeros(len(row), dtype=bool)
    same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (row[1:] == row[:-1])
    distinct = np.bincount(row_counts(row, found.hashes)[0], minlength=n)
    stats = [
        np.log1p(np.diff(offsets)),
        np.log1p(counts),
        np.log1p(np.maximum(np.nan_to_num(n_chars), 0)),
        share((data >= 65) & (data <= 90)),
        share((data >= 97) & (data <= 122)),
        share((data >= 48) & (data <= 57)),
        share(data >= 128),
        share(data == 32),
        share(data == 10),
        share(data == ord("!")),
        share(data == ord("|")),
        share((data == ord("*")) | (data == ord("#")) | (data == ord("$")) | (data == ord("%")) | (data == ord("&"))),
        share((data == ord(".")) | (data == ord(","))),
        share(np.isin(data, np.frombuffer(MARKS, dtype=np.uint8))),
        share(data == ord("@")),
        share(data == ord("/")),
        np.bincount(row, weights=lengths, minlength=n) / n_words / 10,
        np.bincount(row, weights=lengths > 20, minlength=n) / n_words,
        np.bincount(row, weights=lengths < 4, minlength=n) / n_words,
        np.bincount(row, weights=same, minlength=n) / n_words,
        distinct / n_words,
        (counts == 0).astype(np.float64),
    ]
    return np.stack(stats, axis=1)


def features(block: Block, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, word buckets and values of distinct hashed words (unit length by row), and statistics."""
    found = words(block)
    rows, items, often = row_counts(found.row, found.hashes >> np.uint64(64 - 13))
    value = np.log1p(often)
    norm = np.sqrt(np.bincount(rows, weights=value**2, minlength=len(block)))
    return rows, items.astype(np.int64), value / norm[rows], statistics(block, found, n_chars)


class FactorisationMachine:
    """Word buckets first, then statistics, in one feature space."""

    def __init__(self, seed: int = 7):
        size = BUCKETS + STATS
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, RANK))
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)

    def _sparse(self, rows: np.ndarray, items: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.scale, -5, 5) / np.sqrt(STATS)
        n = len(stats)
        return (
            np.concatenate([rows, np.repeat(np.arange(n), STATS)]),
            np.concatenate([items, np.tile(np.arange(BUCKETS, BUCKETS + STATS), n)]),
            np.concatenate([values, z.ravel()]),
        )

    def _sums(self, n: int, rows: np.ndarray, items: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and the factor sums sum_i v_if x_i of each row."""
        parts = self.v[items] * values[:, None]
        factor = np.stack([np.bincount(rows, weights=parts[:, f], minlength=n) for f in range(RANK)], axis=1)
        squares = np.bincount(rows, weights=(parts**2).sum(axis=1), minlength=n)
        linear = np.bincount(rows, weights=self.w[items] * values, minlength=n)
        return self.w0 + linear + 0.5 * ((factor**2).sum(axis=1) - squares), factor

    def score(self, rows: np.ndarray, items: np.ndarray, values: np.ndarray, stats: np.ndarray) -> np.ndarray:
        logits, _ = self._sums(len(stats), *self._sparse(rows, items, values, stats))
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def fit(self, offsets: np.ndarray, items: np.ndarray, values: np.ndarray, stats: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        """Adam on the logistic loss; features of row i are items[offsets[i]:offsets[i + 1]]."""
        n = len(labels)
        if n == 0:
            return self
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        prior = np.clip(labels.mean(), 0.01, 0.99)
        self.w0 = float(np.log(prior / (1 - prior)))
        order = np.random.default_rng(seed)
        slots = {name: (np.zeros_like(getattr(self, name)), np.zeros_like(getattr(self, name))) for name in ("w", "v")}
        step = 0
        for epoch in range(epochs):
            pace = rate / (1 + 0.3 * epoch)
            shuffled = order.permutation(n)
            for at in range(0, n, batch):
                chosen = shuffled[at : at + batch]
                picks = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in chosen]).astype(np.int64)
                local = np.repeat(np.arange(len(chosen)), offsets[chosen + 1] - offsets[chosen])
                rows, cols, x = self._sparse(local, items[picks], values[picks], stats[chosen])
                logits, factor = self._sums(len(chosen), rows, cols, x)
                error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[chosen]) / len(chosen)
                step += 1
                self.w0 -= pace * float(error.sum())
                used, inverse = np.unique(cols, return_inverse=True)
                slope = error[rows] * x
                grad_w = np.bincount(inverse, weights=slope, minlength=len(used)) + decay * self.w[used]
                full = slope[:, None] * (factor[rows] - self.v[cols] * x[:, None])
                grad_v = np.stack([np.bincount(inverse, weights=full[:, f], minlength=len(used)) for f in range(RANK)], axis=1) + decay * self.v[used]
                for name, grad in (("w", grad_w), ("v", grad_v)):
                    first, second = slots[name]
                    first[used] = 0.9 * first[used] + 0.1 * grad
                    second[used] = 0.99 * second[used] + 0.01 * grad**2
                    lift = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    getattr(self, name)[used] -= pace * lift * first[used] / (np.sqrt(second[used]) + 1e-8)
        return self


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fit on at most ``rows`` labelled documents, chosen by ``labelled_sample``; labels that are null or of no document are passed over.

    Without any labelled document, or with empty tables, every score is one half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                n = len(block)
                part = batch.slice(block.first, n)
                row, items, values, stats = features(block, _numbers(part.column(2)))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(ends, pa.array(items.astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float32))),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * STATS + 1, STATS, dtype=np.int32)), pa.array(stats.ravel())),
                    ],
                    names=["label", "items", "vals", "stats"],
                )

    chars = fresh(docs, "_n_chars")
    with Scratch(docs.sparkSession) as scratch:
        sample = labelled_sample(docs.withColumn(chars, _metadata(docs)), labels, "quality", held_out, rows, scratch, (chars,))
        got = map_batches(sample, run, "label int, items array<int>, vals array<float>, stats array<double>").collect()
    got = sorted(got, key=lambda r: (r["label"], r["stats"]))
    model = FactorisationMachine()
    if not got:
        return model
    offsets = np.concatenate([[0], np.cumsum([len(r["items"]) for r in got])]).astype(np.int64)
    items = np.concatenate([np.array(r["items"], dtype=np.int64) for r in got])
    values = np.concatenate([np.array(r["vals"], dtype=np.float64) for r in got])
    stats, marks = np.array([r["stats"] for r in got]), np.array([r["label"] for r in got], dtype=np.float64)
    return model.fit(offsets, items, values, stats, marks)


def _metadata(docs: DataFrame) -> Column:
    """n_chars where there is one, else the text's length."""
    length = F.length(F.coalesce(F.col("text"), F.lit("")))
    return F.coalesce(F.col("n_chars").cast("double"), length.cast("double")) if "n_chars" in docs.columns else length.cast("double")


def score(docs: DataFrame, model: FactorisationMachine, cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted: one row per row of ``docs``, rows that repeat or share an id too.

    Null text is empty, and empty text is scored too; a null ``n_chars`` is the text's length. Texts are read whole. Of the other columns none is read. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = FactorisationMachine()
        vars(model).update(shared.value)
        for batch in batches:
            for block in blocks(batch.column(1)):
                part = batch.slice(block.first, len(block))
                scores = model.score(*features(block, _numbers(part.column(2))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores), pa.array((scores >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _metadata(docs).alias("n_chars"))
    return map_batches(rows, run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    return crc_bucket(4) == 2
