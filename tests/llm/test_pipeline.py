from pathlib import Path

import pytest

import corpus_pipeline
from strandlake.llm import decontaminate, language, mixing
from strandlake.llm.queries import ORACLE_SQL, QUERIES

from .test_dedup import brute_contaminated, classes

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")


def test_pipeline_matches_brute_force(spark):
    """Each stage's effect, worked out row by row from what the stage before kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    encoders = language.Encoders(language.train(docs, held_out=language.held_out()))
    rows = [(r.doc_id, r.text) for r in docs.collect() if not encoders.decide(r.text)[2]]
    newest = {}
    for i, t in rows:
        newest[t] = max(i, newest.get(t, i))
    rows = [(i, t) for i, t in rows if newest[t] == i]
    top = classes(rows)
    rows = [(i, t) for i, t in rows if top[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaked = {i for i, _ in brute_contaminated(rows, items)}
    left = {i for i, _ in rows} - leaked
    sampled = mixing.mix(docs.where(docs.doc_id.isin(sorted(left))), keep_share=True).where("sampled").select("doc_id")
    got = corpus_pipeline.run(spark, DATA)
    assert set(docs.columns) <= set(got.columns)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in sampled.collect())


def test_stages(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op5_line_dedup", "op6_decontamination"])
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    from tests.test_oracle import rows as plain

    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    assert plain(QUERIES[name](spark, DATA).toPandas()) == plain(con.execute(ORACLE_SQL[name]).df())


def test_masks_are_checked(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        decontaminate.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"), masks=("0110",))


def test_release_deletes_tables(spark):
    from strandlake.llm.common import materialise, release

    kept = materialise(spark.range(3), "scratch")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert Path(path).exists()
    release(spark)
    assert not Path(path).exists()
