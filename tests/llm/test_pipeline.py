"""The pipeline: stages in order, contracts between them, and each decision's effect."""

import corpus_pipeline as cp
from tradelens.llm import neardup, secrets
from tradelens.llm.common import read_table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    tables = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = tables[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "secret_scan", "packing"]
    counts = {n: t.count() for n, t in tables.items()}
    assert before >= counts["language_id"] >= counts["line_dedup"] >= counts["near_dedup"] == counts["secret_scan"] > 0.8 * before
    marks = neardup.near_duplicates(tables["line_dedup"]).collect()
    assert counts["near_dedup"] == len({m.component_id for m in marks})
    assert all(not secrets.base_spans(r.text) for r in tables["secret_scan"].select("text").collect())
    packed = {r.doc_id for r in tables["packing"].select("doc_id").collect()}
    assert packed == {r.doc_id for r in tables["secret_scan"].select("doc_id").collect()}


def test_run_equals_its_stages(spark):
    rows = cp.run(spark, SF).count()
    assert rows > 150


def test_odd_documents_pass_through(odd_docs, spark):
    _, df = odd_docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        out.collect()
        assert stage(spark, df.limit(0), SF).collect() == []
    ids = {r.doc_id for r in cp.STAGES[0][1](spark, df, SF).collect()}
    assert not ids & {0, 1, 2}  # no text, no letters
