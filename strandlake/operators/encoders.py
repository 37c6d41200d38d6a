"""Plug-ins by name: feature encoders, label schemes and models applied to batches of columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels, pileup

ENCODERS: dict[str, Callable[..., DataFrame]] = {}
SCHEMES: dict[str, Callable[..., list[str]]] = {
    "haploid": labels.haploid_classes,
    "diploid": labels.diploid_classes,
    "run_length": labels.run_length_classes,
}


def encoder(name: str) -> Callable:
    """Register a function from observations to feature columns."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ENCODERS[name] = f
        return f

    return add


def encode(obs: DataFrame, config: dict) -> DataFrame:
    """Run the encoder that ``config`` names under ``type`` with its ``kwargs``."""
    if config["type"] not in ENCODERS:
        raise KeyError(f"no encoder {config['type']!r}; there are {sorted(ENCODERS)}")
    return ENCODERS[config["type"]](obs, **config.get("kwargs", {}))


@encoder("counts")
def counts(obs: DataFrame, normalise: str | None = "total", symmetric: bool = False) -> DataFrame:
    pile = pileup.counts(obs)
    if symmetric:
        pile = pileup.symmetric_indels(pile)
    if normalise == "total":
        return pileup.normalise_total(pile)
    return pileup.normalise_strands(pile) if normalise == "fwd_rev" else pileup.depth(pile)


@encoder("strata")
def strata(obs: DataFrame, n: int = 3) -> DataFrame:
    return pileup.strata(obs, n)


@encoder("weibull")
def weibull(obs: DataFrame, n: int = 6) -> DataFrame:
    return pileup.weibull_counts(obs, n)


def feature_array(encoded: DataFrame) -> DataFrame:
    """Adds features: the counts in fixed order."""
    return encoded.withColumn("features", F.array(*[F.col(c).cast("float") for c in pileup.COUNTS]))


def predict(chunks: DataFrame, model: Callable[[np.ndarray], np.ndarray], keys: list[str]) -> DataFrame:
    """keys, probs: ``model`` maps an array (chunks, columns, features) to class probabilities of the same columns.

    ``chunks`` has keys and an array of features by column; chunks of one length are run as one batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf.features.map(len)
            for _, part in pdf.groupby(sizes):
                stacked = np.stack([np.array([np.asarray(c, dtype=np.float32) for c in f]) for f in part.features])
                yield part[keys].assign(probs=[[row.tolist() for row in p.astype(np.float64)] for p in model(stacked)])

    kinds = ", ".join(f"{c} {t}" for c, t in chunks.dtypes if c in keys)
    return chunks.select(*keys, "features").mapInPandas(run, f"{kinds}, probs array<array<double>>")


def majority_model(features: np.ndarray) -> np.ndarray:
    """Class probabilities *ACGT of normalised counts: strands summed, what is missing to the gap."""
    bases = features[..., 0:4] + features[..., 4:8]
    gap = features[..., 8:9] + features[..., 9:10]
    rest = np.maximum(0, 1 - gap - bases.sum(axis=-1, keepdims=True))
    return np.concatenate([gap + rest, bases], axis=-1)


def gru_model(weights: list[dict[str, np.ndarray]], out: tuple[np.ndarray, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """A bidirectional GRU with a softmax layer. Each layer has, for ``f`` and ``b``, w (3h x in), u (3h x h), bw and bu in the order reset, update, new."""

    def direction(x: np.ndarray, w: np.ndarray, u: np.ndarray, bw: np.ndarray, bu: np.ndarray) -> np.ndarray:
        size = u.shape[1]
        h, states = np.zeros((x.shape[0], size)), []
        for t in range(x.shape[1]):
            a, b = x[:, t] @ w.T + bw, h @ u.T + bu
            r = 1 / (1 + np.exp(-(a[:, :size] + b[:, :size])))
            z = 1 / (1 + np.exp(-(a[:, size : 2 * size] + b[:, size : 2 * size])))
            h = (1 - z) * np.tanh(a[:, 2 * size :] + r * b[:, 2 * size :]) + z * h
            states.append(h)
        return np.stack(states, axis=1)

    def run(x: np.ndarray) -> np.ndarray:
        for layer in weights:
            ahead = direction(x, *[layer[f"f_{k}"] for k in ("w", "u", "bw", "bu")])
            back = direction(x[:, ::-1], *[layer[f"b_{k}"] for k in ("w", "u", "bw", "bu")])[:, ::-1]
            x = np.concatenate([ahead, back], axis=-1)
        logits = x @ out[0].T + out[1]
        powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return powers / powers.sum(axis=-1, keepdims=True)

    return run
