"""Connected components of links, by large-star and small-star rounds over narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links`, a frame of two id columns, that is not itself the smallest id it reaches.

    Each round points all neighbours of a node at the smallest of them, first those above the node, then those below,
    with a grouping and a join on the node; no group is collected. Rows without change end the rounds. Stars are done
    after one round, long chains take about log(n) of them.
    """
    a, b = links.columns
    edges = written(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct()
    )
    state = None
    while True:
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("s")).first()
        if found == state or not found.n:
            return edges
        state = found
        edges = written(_small_star(_large_star(edges)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.min("root").alias("least")).select("node", F.least("node", "least").alias("least"))
    joined = both.join(least, "node").where(F.col("root") > F.col("node"))
    return joined.select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("node").agg(F.min("root").alias("least"))
    joined = edges.join(least, "node").where(F.col("root") != F.col("least"))
    moved = joined.select(F.col("root").alias("node"), F.col("least").alias("root"))
    return moved.unionByName(least.select("node", F.col("least").alias("root"))).distinct()
