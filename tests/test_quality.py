from datetime import date

import pytest
from pyspark.sql import functions as F

from patronage.operators import quality


def test_row_counts(spark):
    pairs = {"a": (spark.range(3), spark.range(3)), "b": (spark.range(3), spark.range(2)), "c": (spark.range(0), spark.range(0))}
    got = {r["table_name"]: tuple(r)[1:] for r in quality.row_counts(pairs).collect()}
    assert got == {"a": (3, 3, True), "b": (3, 2, False), "c": (0, 0, True)}


def test_segment_domains(spark):
    df = spark.createDataFrame(
        [("High Value", "Lost"), ("Odd", None), ("Low Value", "Others")], "ValueSegment string, BehaviorSegment string"
    )
    domains = {c: quality.fx.SEGMENT_DOMAINS[c] for c in df.columns}
    got = {r["column_name"]: (r["invalid_rows"], r["passed"]) for r in quality.segment_domains(df, domains).collect()}
    assert got == {"ValueSegment": (1, False), "BehaviorSegment": (1, False)}


def test_retention_and_missing_orders(spark):
    history = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3)], "day date")
    assert tuple(quality.retention(history, "day", date(2024, 1, 2)).first()) == (1, False)
    assert tuple(quality.retention(history, "day", date(2024, 1, 1)).first()) == (0, True)
    base, summary = spark.range(5).toDF("CustomerID"), spark.range(2).toDF("CustomerID")
    assert quality.without_orders(base, summary).first()[0] == 3


def test_expected_values(spark):
    actual = spark.createDataFrame([(1, 2, "x"), (2, 3, None)], "k int, n int, t string")
    expected = spark.createDataFrame([(1, 2, "y"), (2, 3, None), (9, 1, None)], "k int, n int, t string")
    got = sorted(map(tuple, quality.expected_values(actual, expected, "k").collect()), key=repr)
    assert got == [
        (1, True, "t", "y", "x"),
        (9, False, "n", "1", None),
        (9, False, "t", None, None),
    ]


def test_reconcile_counts_repeats(spark):
    left, right = spark.createDataFrame([(1,), (1,), (2,)], "a int"), spark.createDataFrame([(1,), (3,)], "a int")
    assert sorted(map(tuple, quality.reconcile(left, right).collect())) == [(1, "left"), (2, "left"), (3, "right")]
    assert quality.reconcile(left, left).isEmpty()


def test_schema_catalog(spark):
    frames = {"t": spark.range(1).select("id", F.lit("x").alias("s")), "u": spark.range(1)}
    rows = sorted(map(tuple, quality.schema_catalog(frames).collect()))
    assert rows == [("t", 0, "id", "bigint", False), ("t", 1, "s", "string", False), ("u", 0, "id", "bigint", False)]


def test_reconcile_by_key_gives_the_rows_of_reconcile(spark):
    import random

    draw = random.Random(3)
    for _ in range(4):
        rows = [(draw.choice([None, *range(30)]), draw.choice(["a", "b", None]), draw.choice([None, 0.0, -0.0, 1.5])) for _ in range(200)]
        other = [r for r in rows if draw.random() < 0.95] + [(draw.randrange(30), "new", None) for _ in range(draw.randrange(3))]
        left, right = (spark.createDataFrame(x, "k long, a string, v double").repartition(n) for x, n in ((rows, 2), (other, 5)))
        want = sorted(map(repr, map(tuple, quality.reconcile(left, right).collect())))
        for buckets in (1, 7, 4096):
            got = quality.reconcile_by_key(left, right.select("v", "a", "k"), "k", buckets)
            assert sorted(map(repr, map(tuple, got.select("k", "a", "v", "only_in").collect()))) == want
    wider = right.withColumn("k", F.col("k").cast("decimal(20,0)"))
    assert quality.reconcile_by_key(left, wider, "k").count() == len(want)
    with pytest.raises(ValueError, match="columns differ: a"):
        quality.reconcile_by_key(left, right.drop("a"), "k")


def test_equal_buckets_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).selectExpr("id as k", "id % 7 as v").write.parquet(path)
    left = spark.read.parquet(path)
    right = left.withColumn("v", F.when(F.col("k") == 5, -1).otherwise(F.col("v")))
    assert len(quality.differing_buckets(left, right, "k", 64)) == 1 and quality.differing_buckets(left, left, "k", 64) == []
    same = quality.reconcile_by_key(left, left.select("*"), "k", 64)
    assert "Exchange" not in same._jdf.queryExecution().optimizedPlan().toString() and same.count() == 0
    assert "LocalRelation <empty>" in same._jdf.queryExecution().optimizedPlan().toString()
    found = quality.reconcile_by_key(left, right, "k", 64)
    assert {(r.k, r.v, r.only_in) for r in found.collect()} == {(5, 5, "left"), (5, -1, "right")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") >= 2 and "pmod(xxhash64" in plan  # rows of other buckets stop at the scan


def test_many_copies_of_one_row(spark):
    left = spark.range(10_000).selectExpr("1 as k")
    found = quality.reconcile(left, spark.range(3).selectExpr("1 as k"))
    assert found.count() == 9_997 and {tuple(r) for r in found.collect()} == {(1, "left")}


def test_sample_is_the_same_rows_however_they_lie(spark):
    df = spark.range(5000).selectExpr("id as k", "case when id % 10 = 0 then null else concat('s', id % 3) end as s")
    draw = lambda d, n, salt="": {(r.s, r.k) for r in quality.stratified_sample(d, "s", "k", n, salt).collect()}
    one = draw(df.repartition(3), 20)
    assert one == draw(df.repartition(11).orderBy(F.desc("k")), 20) and len(one) == 80 and one > draw(df, 5)
    assert one != draw(df, 20, "again")
    assert len(draw(df.where("k < 4"), 20)) == 4
    plan = quality.stratified_sample(df, "s", "k", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # a task sends no more than it has to
