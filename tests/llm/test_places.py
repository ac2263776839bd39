"""Operators and stages on frames that are no plain read of Parquet files."""

import collections

import pytest

import corpus_pipeline
from chronogrid.llm.near_dup import near_duplicates

from .conftest import documents


def shaped(spark, messy, kind):
    docs = spark.read.parquet(f"{messy}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    if kind == "created":
        return spark.createDataFrame([(*r, 0) for r in documents()], docs.schema)
    if kind == "union":
        return docs.filter("doc_id < 6").unionByName(docs.filter("doc_id >= 6 OR doc_id IS NULL"))
    if kind == "join":
        return docs.filter("doc_id <> 5").crossJoin(spark.range(2).select())
    return docs


@pytest.mark.parametrize("kind", ["created", "union", "join"])
def test_stages_and_operator_find_the_same_rows(spark, messy, tmp_path, kind):
    docs = shaped(spark, messy, kind)
    docs.write.parquet(f"{tmp_path}/plain")
    plain = spark.read.parquet(f"{tmp_path}/plain")
    rows = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_dedup):
        got = rows(stage(spark, docs, messy))
        assert got and got == rows(stage(spark, plain, messy))
    groups = lambda df: collections.Counter((r.doc_id, r.component_id) for r in near_duplicates(df).collect())
    assert groups(docs) == groups(plain)
