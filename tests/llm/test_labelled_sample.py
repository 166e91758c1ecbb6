"""What classifiers learn from when labels are one-sided, of absent ids, or of texts over the bound."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patronage.llm import quality, toxicity, words

TEXTS = [(k, f"clean words number {k}" if k % 10 else f"you idiot number {k}") for k in range(200)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string")


@pytest.mark.parametrize(("value", "score"), [(None, 0.5), (0, 0.0), (1, 1.0)])
def test_one_label_value_drops_nothing(spark, documents, tmp_path, value, score):
    folder = str(tmp_path)
    documents.write.parquet(f"{folder}/documents.parquet")
    known = TEXTS if value is not None else []
    labels = spark.createDataFrame([(k, value, value) for k, _ in known], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    for op, least in ((toxicity.op4_toxicity, 0.5), (quality.op9_quality, 0.7)):
        assert {(r.score, r.predicted) for r in op(spark, folder).collect()} == {(score, int(score >= least))}
    for stage in (corpus_pipeline.toxicity_stage, corpus_pipeline.quality_stage):
        assert stage(spark, documents, folder).count() == len(TEXTS)


def test_sample_holds_both_values_of_usable_documents(spark, documents):
    long = spark.createDataFrame([(k, "x" * 500) for k in range(1000, 1300)], "doc_id bigint, text string")
    absent = [(k, 0) for k in range(5000, 9000)]
    marks = [(k, int(k % 10 == 0)) for k, _ in TEXTS] + [(k, 1) for k in range(1000, 1300)] + absent
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    sample, odds = words.labelled_sample(
        documents.union(long), labels, key="doc_id", text="text", label="toxic", learn=F.lit(True), rows=60, max_bytes=100
    )
    assert sorted(y for _, y in sample) == [0] * 40 + [1] * 20
    assert all(len(t) <= 100 and (y == 1) == ("idiot" in t) for t, y in sample)
    assert odds == pytest.approx(math.log((20 / 180) / (20 / 40)))
    assert words.quotas({0: 1000, 1: 1000}, 61) == {0: 30, 1: 31} and words.quotas({}, 60) == {}
