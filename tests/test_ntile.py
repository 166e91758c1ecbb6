import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from patronage.operators.ntile import By, ntile_global


def windowed(df, order, n):
    return df.withColumn("tile", F.ntile(n).over(Window.orderBy(order, "id")))


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 23])
def test_small_sizes(spark, rows):
    df = spark.createDataFrame([(i, (i * 7) % 4) for i in range(rows)], "id long, k int")
    got = {r["id"]: r["tile"] for r in ntile_global(df, {"tile": F.col("k")}, 5, "id").collect()}
    want = {r["id"]: r["tile"] for r in windowed(df, F.col("k"), 5).collect()}
    assert got == want
    sizes = [list(got.values()).count(t) for t in range(1, 6)]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_several_rankings_with_heavy_ties(spark):
    """Two thirds of the rows share one key; ids are not in row order."""
    chance = random.Random(5)
    rows = [(i, 1 if chance.random() < 0.66 else chance.randrange(50), chance.randrange(10**9)) for i in range(5000)]
    chance.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, k int, m long").repartition(16)
    rankings = {"up": F.col("k"), "down": -F.col("m")}
    got = ntile_global(df, rankings, 5, "id")
    want = windowed(windowed(df, F.col("k"), 5).withColumnRenamed("tile", "up"), F.col("m").desc(), 5)
    want = want.withColumnRenamed("tile", "down").select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_decimals_that_differ_in_the_last_digit(spark):
    df = spark.range(40).select("id", (F.col("id") / 100).cast("decimal(15,2)").alias("m"))
    got = ntile_global(df, {"t": -F.col("m")}, 4, "id").groupBy("t").agg(F.min("id").alias("low")).collect()
    assert {r["t"]: r["low"] for r in got} == {1: 30, 2: 20, 3: 10, 4: 0}


@pytest.mark.parametrize("descending", [False, True])
def test_null_keys_and_fine_digits(spark, descending):
    """Nulls first when ascending and last when descending, as the window has them; no key is rounded."""
    data = [(i, None if i % 3 == 0 else i * 1e-5) for i in range(1, 23)]
    df = spark.createDataFrame(data, "id long, k double")
    for kind in ("double", "decimal(38,6)"):
        typed = df.withColumn("k", F.col("k").cast(kind))
        order = F.col("k").desc() if descending else F.col("k").asc()
        got = ntile_global(typed, {"tile": By(F.col("k"), descending)}, 5, "id")
        want = windowed(typed, order, 5)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_many_partitions_small_batches(spark):
    """Ranks must add up over many range partitions, not just one coalesced partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1003).select("id", (F.col("id") % 17).alias("k"))
        got = ntile_global(df, {"tile": F.col("k")}, 10, "id")
        want = windowed(df, F.col("k"), 10)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
