"""The corpus pipeline and the registered queries of the subpackage."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from lodestar.llm import scratch


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, total = docs.columns, docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    # Copies of one another may have lost all their lines to line dedup, so that stage 3 has no more to drop here.
    assert total >= sizes[0] == sizes[1] >= sizes[2] == sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == sizes[3]
    assert corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").sum("length").count() == sizes[3]


def test_ten_queries_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op3_minhash_dedup", "op4_substring_dedup"])
def test_sql_agrees(spark, sf_dir, name):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = __spark_entry__.queries()[name](spark, sf_dir)
    want = base.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
