"""The pipeline's stages: what they keep, against brute force, and odd inputs."""

import os

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from test_ngram_join import brute
from test_text_operators import hits

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    kept = [tuple(r) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, FOLDER)
        assert out.columns == docs.columns
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) <= set(kept) and rows
        if name == "near_duplicates":
            assert sorted(r[0] for r in rows) == sorted({c for _, _, c in brute([(r[0], r[1]) for r in kept], 5, 80, 100)})
        if name == "decontamination":
            assert sorted(r[0] for r in rows) == sorted(r[0] for r in kept if not hits(r[1], items, 10)[1])
        kept, docs = rows, spark.createDataFrame(rows, docs.schema)
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {r[0]: library.encode(r[1]) for r in kept}
    found = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == want
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, FOLDER).collect()} == want


def test_odd_documents(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "some words " * 20000, None, "s", None), (3, None, "fr", None, 1)]
    for _, step in corpus_pipeline.STAGES:
        for table in (rows, []):
            out = step(spark, spark.createDataFrame(table, schema), FOLDER)
            assert len(out.collect()) <= len(table)


def test_nothing_is_toxic_without_labels(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
