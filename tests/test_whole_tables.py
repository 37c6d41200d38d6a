"""A query over all rows of its table against brute force."""

import hashlib
from pathlib import Path

import pytest

from strandlake.plans.queries import QUERIES

from .test_oracle import DATA

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")


def test_reverse_complement_of_all_documents(spark):
    turn = str.maketrans("ACGTacgt", "TGCAtgca")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {r.doc_id: r.text if r.text is None else hashlib.md5(r.text.translate(turn)[::-1].encode()).hexdigest() for r in docs}
    assert {r.doc_id: r.seq_md5 for r in QUERIES["str1_reverse_complement"](spark, DATA).collect()} == want
