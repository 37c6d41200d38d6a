"""Polishing drafts whole in a task: the same as with a row for each base, without such rows."""

import random

import numpy as np
import pytest

from strandlake.operators import encoders
from strandlake.plans import pipelines, polish

from .test_polish import planted

READS = "name string, read string, seq string"


def molecules(spark, n=6, reads=9, top=300):
    rng = random.Random(11)
    truth = {f"m{k}": "".join(rng.choice("ACGT") for _ in range(rng.randrange(40, top))) for k in range(n)}
    drafts = [(k, planted(rng, s, 6)) for k, s in truth.items()] + [("bare", "ACGT"), ("odd", "ACGTNACGT")]
    rows = [(k, f"r{i}", planted(rng, s, len(s) // 15)) for k, s in truth.items() for i in range(reads)]
    rows += [("odd", "a", "ACGTNACGT"), ("odd", "b", "acgāNACGT"), ("odd", "c", "TTACG*NACGTTT"), ("m0", "z", ""), ("nobody", "y", "ACG")]
    return spark.createDataFrame(drafts, "name string, seq string"), spark.createDataFrame(rows, READS)


def polished(*args, **how):
    return {r.name: (r.seq, r.rounds, r.settled) for r in polish.polish(*args, **how).collect()}


def test_no_base_is_a_row(spark, monkeypatch):
    """A draft of few bases goes through a round without the pileup that has a row for each base of each read."""
    drafts, subreads = molecules(spark)
    want = polished(drafts, subreads, whole=0, rounds=2)

    def refuse(*args, **how):
        raise AssertionError("a row for each base")

    monkeypatch.setattr(pipelines, "inference", refuse)
    # A draft whose reads come in many batches is the same.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert polished(drafts, subreads, rounds=2) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("kwargs", [{}, {"normalise": None}])
def test_same_with_other_settings(spark, kwargs):
    """Chunks of long pieces, too: the model tells where in its chunk a column is, so cuts show."""

    def model(features):
        probs = encoders.majority_model(features) if kwargs.get("normalise", "total") else np.pad(features[..., 4:8], ((0, 0), (0, 0), (1, 0)))
        probs = probs.copy()
        probs[:, ::7, 1] += 0.3
        probs[:, -5:, 2] += 0.4
        return probs

    drafts, subreads = molecules(spark, n=2, reads=4, top=120)
    old = pipelines.CHUNK, pipelines.OVERLAP
    pipelines.CHUNK, pipelines.OVERLAP = 30, 7
    try:
        found = [polished(drafts, subreads, model=model, rounds=1, config={"type": "counts", "kwargs": kwargs}, whole=whole) for whole in (0, polish.WHOLE)]
    finally:
        pipelines.CHUNK, pipelines.OVERLAP = old
    assert found[0] == found[1]
