"""The corpus pipeline: from all documents to the token digests of those worth keeping.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its result is written as
Parquet and read again. Stages but the last return the columns of `documents`, whatever these are, and drop rows:

- toxicity: documents that score as toxic go;
- quality: documents that score as low quality go;
- near_duplicates: of each group of documents that reach each other by links, the one with the smallest id stays;
- decontamination: documents go that hold benchmark passages in at least one word of twenty;
- sentencepiece: returns id, number of tokens and digests of each document left.

Classifiers learn from the stage's own documents that have a label and are not held out; where these do not hold both
label values, the stage keeps all. Documents without id are
scored like others and have no near duplicates. Rows that repeat an id are one document to the third stage where their
texts are equal or reach each other by links: one of these stays, that with the least text. Other rows of one id are
different documents. Extra columns may have any name. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import decontaminate, ngram_join, pieces, quality, toxicity
from patronage.llm.common import column_ref, table, written


#: Near duplicates share this many hundredths of their shingles of so many words; op2_ngram_join has its own setting.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def unused(docs: DataFrame, name: str) -> str:
    """The name, made longer until no column has it."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if not toxicity.learned(model):
        return docs
    into = unused(docs, "toxicity")
    scored = toxicity.score(docs, model, into=into)
    return scored.where(F.col(into) < toxicity.THRESHOLD).select(*[column_ref(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not quality.learned(model):
        return docs
    into = unused(docs, "quality")
    scored = quality.score(docs, model, into=into)
    return scored.where(F.col(into) >= quality.THRESHOLD).select(*[column_ref(c) for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes, _ = ngram_join.ngram_join(docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    dropped = classes.where(F.col("id") != F.col("component_id")).select("id").distinct()
    kept = docs.join(dropped, docs["doc_id"] == dropped["id"], "left_anti")
    repeated = kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    if not repeated.head(1):
        return kept
    repeated = written(repeated)
    once = kept.join(repeated, kept["doc_id"] == repeated["id"], "left_anti")
    return once.unionByName(one_of_repeated(kept.join(repeated, kept["doc_id"] == repeated["id"], "left_semi")))


def one_of_repeated(rows: DataFrame) -> DataFrame:
    """Of the rows of one id that are equal or linked, the one with the least text, null first."""
    name, columns = unused(rows, "row"), rows.columns
    different = written(rows.dropDuplicates(["doc_id", "text"]).withColumn(name, F.xxhash64("doc_id", "text", F.col("text").isNull())))
    classes, _ = ngram_join.ngram_join(different, key=name, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    placed = different.select(F.col("doc_id").alias("of"), F.col(name).alias("id"), "text").join(classes.select("id", "component_id"), "id")
    ahead = F.struct(F.col("text").isNotNull(), "text", "id")
    stays = placed.groupBy("of", "component_id").agg(F.min(ahead)["id"].alias("stays")).select("stays")
    return different.join(stays, different[name] == stays["stays"], "left_semi").select(*[column_ref(c) for c in columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    into = unused(docs, "scan")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), into=into)
    return found.where(~decontaminate.contaminated(into)).select(*[column_ref(c) for c in docs.columns])


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(docs, public_tokenizers.path(pieces.MODEL))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]
# Trained classifiers and the tokenizer cannot be expressed in SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
