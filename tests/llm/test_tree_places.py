"""How the members and askers of small trees are spread over places."""

from pyspark.sql import functions as F

from patronage.llm import ngram_join


def test_small_trees_share_places_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    ids = spark.range(400 * 60).select(
        F.col("id"), (F.col("id") % 400).alias("tree"), (F.col("id") % 3 == 0).alias("asks"), F.lit(9).alias("n_shingles"), F.lit(b"").alias("point")
    )
    groups = ngram_join.NgramJoin.dealt(ids).groupBy("small", "place", "qb", "mb")
    sizes = [r["count"] for r in groups.count().collect()]
    assert sum(sizes) == 400 * 60 and max(sizes) <= 2 * 8 * 64 and len(sizes) > 20


def test_a_large_tree_has_a_place_for_each_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    ids = spark.range(300).select("id", F.lit(7).alias("tree"), (F.col("id") < 150).alias("asks"), F.lit(9).alias("n_shingles"), F.lit(b"").alias("point"))
    dealt = ngram_join.NgramJoin.dealt(ids)
    assert dealt.select("qb", "mb").distinct().count() == 9 and dealt.where("small").count() == 0
    assert dealt.count() == 300 * 3
