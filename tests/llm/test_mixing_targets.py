"""Targets of 0, for absent values and for some dimensions only; columns with the operator's own working names."""

import pytest

from strandlake.llm import mixing

SCHEMA = "doc_id long, source string, lang string, text string, _mix_source string, _strandlake_id int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"s{i % 3}", "en" if i % 2 else "fr", "some words here " * (i % 7 + 1), "mine", 5) for i in range(300)], SCHEMA)


def shares(out):
    rows = out.collect()
    weight = {}
    for r in rows:
        weight[r.source] = weight.get(r.source, 0.0) + r.mix_tokens * r.mix_prob
    total = sum(weight.values())
    return len(rows), {k: v / total for k, v in weight.items()}, {(r["_mix_source"], r["_strandlake_id"]) for r in rows}


@pytest.mark.parametrize(
    ("targets", "want"),
    [
        ({"source": {"s0": 0.0, "s1": 1.0}}, {"s0": 0.0, "s1": 1.0, "s2": 0.0}),
        ({"source": {"s0": 0.5, "absent": 0.5}}, {"s0": 1.0, "s1": 0.0, "s2": 0.0}),
        ({"lang": 1.0, "source": {"s0": 0.2, "s1": 0.3, "s2": 0.5}}, {"s0": 0.2, "s1": 0.3, "s2": 0.5}),
    ],
)
def test_targets(docs, targets, want):
    n, got, extra = shares(mixing.mix(docs, targets=targets))
    assert n == 300 and extra == {("mine", 5)}
    assert got == pytest.approx(want, abs=1e-6)


def test_impossible_targets(docs):
    with pytest.raises(ValueError, match="no value of source"):
        mixing.mix(docs, targets={"source": {"absent": 1.0}})
    with pytest.raises(ValueError, match="not colour"):
        mixing.mix(docs, targets={"colour": 1.0})
