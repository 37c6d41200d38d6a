"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Document counts of hashed n-grams by class are summed over the training sample by Spark; the
n-grams whose counts differ most surely between classes become features, each with its
log-count ratio as value. A logistic model over them is fitted on the driver and folded with the
ratios into one weight a hash, so scoring looks up every n-gram of a whole text and sums the
weights of distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, map_batches
from .sampling import labelled_sample
from .textbatch import LOWER, Block, blocks

SIZES, BITS = (3, 4, 5, 6), 20
#: Bounds of fitting: labelled rows, features, and the least documents and standard errors of a feature.
TRAIN_ROWS, FEATURES, MIN_DOCS, MIN_Z = 12_000, 4096, 4, 4.0
CUT = 0.5


def ngrams(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: hashes of the n-grams at every character of the block, and each row's first character."""
    codes = np.frombuffer(LOWER[block.data].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    begins = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    chars = begins[block.offsets]
    factor, value = np.uint32(0x01000193), codes.copy()
    for size in range(2, max(SIZES) + 1):
        if len(value) <= 1:
            return
        value = value[:-1] * factor ^ codes[size - 1 :]
        if size in SIZES:
            hashed = value * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
            yield size, (hashed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), chars


def present(block: Block, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs of the block whose hash is set in ``table``."""
    keys = []
    for size, hashed, chars in ngrams(block):
        at = np.flatnonzero(table[hashed])
        row = np.searchsorted(chars, at, side="right") - 1
        whole = at + size <= chars[row + 1]
        keys.append(row[whole].astype(np.int64) << BITS | hashed[at[whole]].astype(np.int64))
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, everything = np.zeros((2, 1 << BITS), dtype=np.int64), np.ones(1 << BITS, dtype=bool)
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(1), 1 << 19):
            row, hashed = present(block, everything)
            positive = label[block.first + row] == 1
            counts[0] += np.bincount(hashed[~positive], minlength=1 << BITS)
            counts[1] += np.bincount(hashed[positive], minlength=1 << BITS)
    seen = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, counts[0][seen], counts[1][seen])], names=["h", "c0", "c1"])


def train(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """One weight a hash, and the bias, fitted on at most ``rows`` labelled documents, chosen by ``labelled_sample``.

    Labels that are null or of no document are passed over. Without both classes, or with empty tables, scores are the prior.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _fit(labelled_sample(docs, labels, "toxic", held_out, rows, scratch))


def _fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from label and text of a bounded sample, whose texts are read where they are."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    weights = np.zeros(1 << BITS)
    if not n0 or not n1:
        return weights, bias
    counts = map_batches(sample, _count_batches, "h long, c0 long, c1 long").groupBy("h").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    both = F.col("c0") + F.col("c1")
    ratio = F.log((F.col("c1") + 1) / (n1 + 2)) - F.log((F.col("c0") + 1) / (n0 + 2))
    p = (both + 1) / (n0 + n1 + 2)
    z = F.abs(F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    best = counts.where(both >= MIN_DOCS).select("h", ratio.alias("r"), z.alias("z")).where(F.col("z") >= MIN_Z)
    best = best.orderBy(F.desc("z"), "h").limit(FEATURES).collect()
    if not best:
        return weights, bias
    hashes, ratios = np.array([b["h"] for b in best]), np.array([b["r"] for b in best])
    table = np.zeros(1 << BITS, dtype=bool)
    table[hashes] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                row, hashed = present(block, table)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(block)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashed.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), lists], names=["label", "found"])

    got = map_batches(sample, run, "label int, found array<int>").collect()
    place = np.zeros(1 << BITS, dtype=np.int64)
    place[hashes] = np.arange(len(hashes))
    row = np.repeat(np.arange(len(got)), [len(g["found"]) for g in got])
    item = place[np.concatenate([np.array(g["found"], dtype=np.int64) for g in got])]
    label = np.array([g["label"] for g in got], dtype=np.float64)
    weight, bias = _logistic(row, item, ratios[item], label, len(hashes), bias)
    weights[hashes] = weight * ratios
    return weights, bias


def _logistic(row: np.ndarray, item: np.ndarray, value: np.ndarray, label: np.ndarray, size: int, bias: float, steps: int = 500, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the logistic loss with a quadratic penalty."""
    w = np.zeros(size + 1)
    w[size] = bias
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        logits = np.bincount(row, weights=w[item] * value, minlength=len(label)) + w[size]
        error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - label) / len(label)
        grad = np.append(np.bincount(item, weights=error[row] * value, minlength=size) + decay * w[:size], error.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= 0.02 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * first / (np.sqrt(second) + 1e-9)
    return w[:size], float(w[size])


def score(docs: DataFrame, weights: np.ndarray, bias: float, cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted: one row per row of ``docs``, rows that repeat or share an id too.

    Null text is empty, and empty text is scored too. Texts are read whole. Of the other columns none is read. An empty
    table gives an empty result.
    """
    used = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, weights[used], bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[used] = values
        table = dense != 0
        for batch in batches:
            for block in blocks(batch.column(1)):
                row, hashed = present(block, table)
                logits = np.bincount(row, weights=dense[hashed], minlength=len(block)) + bias
                scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(scores), pa.array((scores >= cut).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    return crc_bucket(5) == 0
