"""Every stage of the pipeline against plain code, on what its predecessor kept."""

import collections

import corpus_pipeline

from . import plain


def test_stages(spark, messy, tmp_path):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, messy).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
    before, after = kept["quality_rules"]
    assert {r.doc_id for r in after} <= {i for i, t in before if not plain.rules(t)[5]}
    before, after = kept["line_dedup"]
    want = collections.Counter((i, digest) for i, _, _, digest in plain.line_dedup(before))
    assert want == collections.Counter((r.doc_id, plain.sha(r.text or "")) for r in after)
    before, after = kept["near_dedup"]
    groups = collections.Counter(c for _, n, c in plain.components(before, corpus_pipeline.SIMILARITY) if n)
    assert len(after) == len(groups) + sum(not plain.shingles(t) for _, t in before)
    before, after = kept["mix_sources"]
    copies = collections.Counter((r.doc_id, r.text) for r in after)
    assert set(copies) <= set(before) and max(copies.values()) <= 3
    before, after = kept["best_fit_packing"]
    assert collections.Counter(i for i, _ in before) == collections.Counter(r.doc_id for r in after if r.piece == 0)


def test_run_on_an_empty_table(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
