"""The queries and the pipeline's stages on the smallest tables."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from shapewright.llm import ngram_join

    docs, before = spark.read.parquet(f"{FOLDER}/documents.parquet"), None
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == DOCUMENT and 0 < docs.count() <= before.count()
        if name == "ngram_join":
            joined = ngram_join.similarity_join(before)
            assert docs.count() == joined.select("class_id").distinct().count()
            assert ngram_join.similarity_join(docs).where("n_links > 0").count() == 0
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_stages_on_empty_documents(spark):
    import corpus_pipeline

    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


@pytest.mark.parametrize("name", ["op3_language_id", "op5_toxicity", "op10_quality_classifier"])
def test_one_row_per_document(spark, name):
    from shapewright.llm.registry import QUERIES

    got = QUERIES[name](spark, FOLDER)
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
