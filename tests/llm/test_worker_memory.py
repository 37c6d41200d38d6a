"""What a Python worker keeps between tasks."""

import resource

import pyarrow as pa
from pyspark import cloudpickle

from strandlake.llm import near_dedup, textbatch


def _task():
    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "digest": b"a", "row_no": 1, "text": "one two three four five six"}])
    return list(near_dedup._signature_batches(iter([batch]), 5, 34, 6))


def test_tasks_share_one_table():
    """Twenty tasks that unpickle the function use the same power tables, which take 33 MB."""
    sent = cloudpickle.dumps(near_dedup._signature_batches)
    assert len(sent) < 1000
    _task()
    kept, before = textbatch._powers["up"], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in range(20):
        assert cloudpickle.loads(sent) is near_dedup._signature_batches
        _task()
    assert textbatch._powers["up"] is kept
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 30_000
