"""Pages from one sort, batches that go on after a failure, and bucketed tables."""

import uuid
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from patronage import queries as registry
from patronage.operators import merge
from patronage.operators.paging import KeyOrder, pages
from patronage.sources import batches


def test_pages_follow_the_order_of_the_key(spark):
    keys = [(7 * k) % 1000 for k in range(1000)]
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string").repartition(5)
    for size in (1, 7, 100, 999, 1000, 5000):
        found = pages(df, "k", size)
        assert found.count == -(-1000 // size)
        assert {r.k: r.page for r in found.numbered().collect()} == {k: k // size for k in range(1000)}
        for n in {0, found.count // 2, found.count - 1}:
            assert sorted(r.k for r in found.page(n).collect()) == list(range(1000))[n * size : (n + 1) * size]
    assert {r.k: r.page for r in pages(df, "k", 100).numbered(first=5).collect()}[999] == 14
    assert found.page(found.count).count() == 0
    with pytest.raises(ValueError, match="at least one row"):
        pages(df, "k", 0)


def test_pages_of_little_and_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (1, 3)], "k long, v int")
    assert sorted((r.v, r.page) for r in pages(df, "k", 2).numbered().collect()) == [(1, 0), (2, 1), (3, 0)]
    empty = pages(df.where("false"), "k", 2)
    assert empty.count == 0 and empty.numbered().count() == 0


def test_one_page_reads_the_files_it_lies_in(spark):
    df = spark.range(0, 100_000, 1, 8).withColumnRenamed("id", "k")
    page = pages(df, "k", 1000).page(50)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(__place" in plan and "Exchange" not in plan
    assert page.count() == 1000


def jobs_of(spark, call):
    """What a call returns and how many jobs it ran."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return call(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_page_after_page_costs_few_jobs(spark, tmp_path):
    n, at = 120_500, str(tmp_path)
    customer = F.expr("id c_custkey"), F.expr("concat('C#', id) c_name"), F.expr("1 c_nationkey"), F.expr("1D c_acctbal"), F.expr("'A' c_mktsegment")
    spark.range(n).select(*customer).repartition(3).write.parquet(f"{at}/customer.parquet")
    spark.range(9).select(F.col("id").alias("o_custkey"), F.expr("timestamp'2001-01-01' o_orderdate")).write.parquet(f"{at}/orders.parquet")
    found, jobs = jobs_of(spark, lambda: registry.queries()["q_page_markers"](spark, at))
    assert sorted(map(tuple, found.collect())) == [(p, min(n, 1000 * (p + 1)) - 1) for p in range(121)]
    assert jobs < 60


@pytest.mark.parametrize(
    ("keys", "size", "last"),
    [
        ([k for k in range(60) for _ in range(1 + k % 7)], 10, -1),  # keys that lie across the ends of pages
        ([3] * 500 + [*range(40)], 7, 1),
        ([None, None, -5, -1, 0, None, 7], 1, -3),
        ([f"k{k * k % 91}" for k in range(300)], 25, "k1"),
        ([], 5, 0),
    ],
)
def test_pages_ahead_keep_to_repeated_keys(spark, keys, size, last):
    df = spark.createDataFrame([(k,) for k in keys], f"k {'string' if isinstance(last, str) else 'long'}").repartition(4)

    def plain(last):
        page = sorted(k for k in keys if k is not None and k > last)[:size]
        return page[-1] if page else None

    order = KeyOrder(df, "k")
    assert merge.next_page_key(order, "k", last, size) == merge.next_page_key(df, "k", last, size)
    while last is not None:
        found = merge.next_page_key(order, "k", last, size)
        assert found == plain(last)
        last = found
    for other in [k for k in keys if k is not None][-1:]:  # not the one that follows
        assert merge.next_page_key(order, "k", other, size) == plain(other)
    with pytest.raises(ValueError, match="order of k"):
        merge.next_page_key(order, "other", 0, 3)


@pytest.mark.parametrize(
    ("kind", "value"),
    [("bigint", lambda k: k * 3), ("string", lambda k: f"key {k:03d}"), ("date", lambda k: date.fromordinal(730_000 + k)), ("decimal(10,2)", lambda k: Decimal(k) / 4)],
)
def test_a_write_goes_on_after_the_marker(spark, store, kind, value):
    df = spark.createDataFrame([(value(k), k) for k in range(50)], f"k {kind}, v int").repartition(3)
    seen = []

    def stop(batch, rows):
        seen.append((batch, rows))
        if batch == 2:
            raise InterruptedError

    with pytest.raises(InterruptedError):
        batches.write_in_batches(store, df, "gold", "B", "k", 8, stop)
    assert seen == [(0, 8), (1, 8), (2, 8)] and batches.marker(store, "gold", "B")["batch"] == 2
    again = []
    assert batches.write_in_batches(store, df, "gold", "B", "k", 10, lambda *x: again.append(x)) == 26
    assert again == [(3, 10), (4, 10), (5, 6)]  # nothing before the marker is written again
    rows = store.read("gold", "B").collect()
    assert sorted((r.v, r.k) for r in rows) == [(k, value(k)) for k in range(50)]
    assert [r.Batch for r in sorted(rows, key=lambda r: r.v)] == [k // 8 if k < 24 else 3 + (k - 24) // 10 for k in range(50)]
    assert batches.write_in_batches(store, df, "gold", "B", "k", 10) == 0
    batches.start_over(store, "gold", "B")
    assert batches.write_in_batches(store, df, "gold", "B", "k", 20) == 50


def test_a_batch_whose_write_fails_is_written_again(spark, store):
    good = spark.createDataFrame([(k, k) for k in range(30)], "k long, v int")
    bad = good.withColumn("v", F.when(F.col("k") == 17, F.raise_error(F.lit("boom")).cast("int")).otherwise(F.col("v")))
    real = store.replace_partitions

    def lost(df, layer, name, partition, evolve=False):
        real(df, layer, name, partition, evolve)
        if partition["Batch"] == 1:
            raise OSError("the marker was not moved")
        return 0

    store.replace_partitions = lost
    with pytest.raises(OSError):
        batches.write_in_batches(store, good, "gold", "B", "k", 10)
    del store.replace_partitions
    assert batches.marker(store, "gold", "B") == {"batch": 0, "key": "9"}
    with pytest.raises(Exception, match="boom"):
        batches.write_in_batches(store, bad, "gold", "B", "k", 10)
    assert batches.write_in_batches(store, good, "gold", "B", "k", 10) == 20
    assert sorted(r.k for r in store.read("gold", "B").collect()) == list(range(30))


def test_small_batches_are_written_several_by_one_job(spark, store):
    df = spark.range(0, 600, 1, 4).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    (written, jobs) = jobs_of(spark, lambda: batches.write_in_batches(store, df, "gold", "B", "k", 3))
    assert written == 600 and jobs < 100  # of 200 batches
    assert batches.marker(store, "gold", "B") == {"batch": 199, "key": "599"}
    assert {(r.k, r.v, r.Batch) for r in store.read("gold", "B").collect()} == {(k, f"v{k}", k // 3) for k in range(600)}
    for batch in (0, 77, 199):
        part = store.read_partition("gold", "B", {"Batch": batch})
        assert [r.k for r in part.collect()] == [3 * batch, 3 * batch + 1, 3 * batch + 2] and len(part.inputFiles()) == 1


def test_batches_beyond_the_marker_are_removed(spark, store, monkeypatch):
    df = spark.createDataFrame([(k, k) for k in range(50)], "k long, v int")
    left = lambda: sorted(r.k for r in store.read("gold", "B").collect())

    def stop(batch, rows):
        if batch == 5:  # in the middle of those that one job wrote
            raise InterruptedError

    with pytest.raises(InterruptedError):
        batches.write_in_batches(store, df, "gold", "B", "k", 2, stop)
    assert batches.marker(store, "gold", "B") == {"batch": 5, "key": "11"} and left() == list(range(12))

    put = store._put

    def lost(path, value):
        if path.endswith(batches.MARKER) and value["batch"] > 8:
            raise OSError("the marker was not moved")
        put(path, value)

    monkeypatch.setattr(store, "_put", lost)
    with pytest.raises(OSError):
        batches.write_in_batches(store, df, "gold", "B", "k", 2)
    monkeypatch.undo()
    assert batches.marker(store, "gold", "B")["batch"] == 7
    seen = []
    assert batches.write_in_batches(store, df, "gold", "B", "k", 30, lambda *x: seen.append(x)) == 34
    assert seen == [(8, 30), (9, 4)] and left() == list(range(50))


def test_keys_of_batches_are_unique_and_known(spark, store):
    with pytest.raises(ValueError, match="k 1 occurs more than once"):
        batches.write_in_batches(store, spark.createDataFrame([(1,), (1,)], "k long"), "gold", "B", "k")
    with pytest.raises(ValueError, match="k is null"):
        batches.write_in_batches(store, spark.createDataFrame([(1,), (None,)], "k long"), "gold", "B", "k")


def test_bucketed_tables_are_joined_where_they_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = registry.queries()["q_bucketed_join"](spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2
        assert found.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
