"""The pipeline's stages against what each operator decides."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import quality_classifier
from tests.llm.test_line_dedup import dropped
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.classified(spark, docs, SF).cache()
    scored = quality_classifier.score(docs, quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in scored.where("predicted = 1").collect()}
    second = corpus_pipeline.lines_deduplicated(spark, first, SF).cache()
    rows = [(r.doc_id, r.text) for r in first.collect()]
    want = {i: t for i, _, n, t in dropped(rows, 10, "first") if not (n and not t.strip(" \t\n\x0b\x0c\r"))}
    assert {r.doc_id: r.text for r in second.collect()} == want
    third = corpus_pipeline.near_duplicates_dropped(spark, second, SF).cache()
    kept = {i for i, _, c in brute([(r.doc_id, r.text) for r in second.collect()], 5, 80) if i == c}
    assert {r.doc_id for r in third.collect()} == kept
    fourth = corpus_pipeline.mixed(spark, third, SF)
    assert fourth.columns == docs.columns and sorted(fourth.collect()) == sorted(third.collect())
    last = corpus_pipeline.encoded(spark, fourth, SF)
    assert last.where("not round_trip").count() == 0 and last.count() == third.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(kept)


def test_empty_and_null_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)], schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, frame, SF)
            assert set(schema.names) <= set(made.columns)
            made.select(F.count("*")).collect()
