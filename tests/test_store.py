from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from patronage.operators import merge
from patronage.sources.durable import SETTING, durable, scratch_path, shared_dir

OLD, NOW = datetime(2024, 1, 1), datetime(2024, 2, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def people(spark, *values):
    return spark.createDataFrame(list(values), "CustomerID long, Name string, CreatedDate date")


def test_paths_and_presence(store):
    assert store.path("bronze", "dbo.Orders").endswith("/bronze/dbo_Orders")
    assert not store.exists("bronze", "dbo.Orders")
    with pytest.raises(FileNotFoundError, match="dbo.Orders"):
        store.read("bronze", "dbo.Orders")


def test_overwrite_may_read_what_it_replaces(spark, store):
    assert store.overwrite(spark.range(5), "silver", "N") == 5
    for expected in (10, 20, 40):
        current = store.read("silver", "N")
        assert store.overwrite(current.unionAll(current), "silver", "N") == expected
    assert store.read("silver", "N").count() == 40
    assert len(store._versions(store.path("silver", "N"))) == 2  # the current one and its predecessor


def test_failed_write_keeps_the_old_version(spark, store):
    store.overwrite(spark.range(5), "silver", "N")
    bad = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        store.overwrite(bad, "silver", "N")
    assert store.read("silver", "N").count() == 5
    assert store.overwrite(spark.range(2), "silver", "N") == 2
    assert store.read("silver", "N").count() == 2


def test_partitions_are_replaced_one_by_one(spark, store):
    days = [date(2024, 1, d) for d in (1, 2, 3)]
    for day in days:
        assert store.replace_partitions(spark.range(4), "gold", "T", {"day": day}) == 4
    assert store.replace_partitions(spark.range(1), "gold", "T", {"day": days[1]}) == 1
    per_day = {r["day"]: r["count"] for r in store.read("gold", "T").groupBy("day").count().collect()}
    assert per_day == {days[0]: 4, days[1]: 1, days[2]: 4}
    assert store.replace_partitions(spark.range(0), "gold", "T", {"day": days[1]}) == 0
    assert {r["day"] for r in store.read("gold", "T").collect()} == {days[0], days[2]}
    assert store.drop_before("gold", "T", "day", days[2]) == ["day=2024-01-01"]
    assert store.drop_before("gold", "T", "day", days[2]) == []
    assert {r["day"] for r in store.read("gold", "T").collect()} == {days[2]}


def test_partition_by_name(spark, store):
    df = spark.createDataFrame([(1, "Active"), (2, "Churned")], "id int, LifecycleSegment string")
    store.overwrite(df, "gold", "S", ["LifecycleSegment"])
    assert rows(store.read("gold", "S", F.col("LifecycleSegment") == "Active").select("id")) == [(1,)]


def test_append_and_schema_check(spark, store):
    store.append(spark.range(2), "gold", "L")
    store.append(spark.range(3), "gold", "L")
    assert store.read("gold", "L").count() == 5
    with pytest.raises(ValueError, match="columns differ.*id"):
        store.append(spark.range(2).select(F.col("id").cast("string")), "gold", "L")


def test_upsert(spark, store):
    first, second = date(2020, 1, 1), date(2021, 1, 1)
    store.upsert(people(spark, (1, "a", first), (2, "b", first)), "gold", "P", "CustomerID", OLD, ("CreatedDate",))
    changes = people(spark, (2, None, second), (3, "c", second))
    assert store.upsert(changes, "gold", "P", "CustomerID", NOW, ("CreatedDate",)) >= 2  # rows of touched buckets
    assert sorted(store.read("gold", "P").collect(), key=lambda r: r[0]) == [
        (1, "a", first, OLD),
        (2, None, first, NOW),
        (3, "c", second, NOW),
    ]
    assert store.upsert(changes, "gold", "P", "CustomerID", NOW, ("CreatedDate",)) >= 2
    with pytest.raises(ValueError, match="CustomerID 2 occurs more than once"):
        store.upsert(changes.unionAll(changes.where("CustomerID = 2")), "gold", "P", "CustomerID", NOW)
    assert store.read("gold", "P").count() == 3


def test_upsert_without_success_markers(spark, store):
    """A cluster may switch off the marker files; the store does not look at them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        day = date(2020, 1, 1)
        for k in range(4):
            store.upsert(people(spark, (k, "a", day), (k + 1, "b", day)), "gold", "P", "CustomerID", NOW)
        assert [r[0] for r in rows(store.read("gold", "P").select("CustomerID"))] == [0, 1, 2, 3, 4]
        assert store.overwrite(spark.range(3), "silver", "N") == 3 and store.read("silver", "N").count() == 3
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_upsert_writes_touched_buckets_only(spark, store):
    day = date(2020, 1, 1)
    many = spark.range(2000).select(F.col("id").alias("CustomerID"), F.lit("a").alias("Name"), F.lit(day).alias("CreatedDate"))
    assert store.upsert(many, "gold", "P", "CustomerID", OLD) == 2000
    path = store.path("gold", "P")

    def files():
        version, record = store._committed(path)[-1]
        return {b: (v, tuple(store._children(f"{path}/{v}/key_bucket={b}"))) for b, v in record["buckets"].items()}

    before = files()
    written = store.upsert(people(spark, (7, "x", day), (5000, "y", day)), "gold", "P", "CustomerID", NOW)
    after = files()
    assert 0 < written < 200
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert store.read("gold", "P").count() == 2001
    assert rows(store.read("gold", "P").where("Name <> 'a'").select("CustomerID", "Name")) == [(7, "x"), (5000, "y")]
    for k in range(3):  # old versions go bucket by bucket, rows stay
        store.upsert(people(spark, (7, f"x{k}", day)), "gold", "P", "CustomerID", NOW)
    assert store.read("gold", "P").count() == 2001
    assert rows(store.read("gold", "P").where("CustomerID in (7, 5000)").select("Name")) == [("x2",), ("y",)]


def test_failed_upsert_and_uncommitted_versions(spark, store):
    day = date(2020, 1, 1)
    store.upsert(people(spark, (1, "a", day)), "gold", "P", "CustomerID", OLD)
    bad = people(spark, (1, "b", day)).withColumn("Name", F.raise_error(F.lit("boom")))
    with pytest.raises(Exception, match="boom"):
        store.upsert(bad, "gold", "P", "CustomerID", NOW, key_checked=True)
    assert rows(store.read("gold", "P").select("Name")) == [("a",)]
    spark.range(3).write.parquet(f"{store.path('gold', 'Q')}/v00000001")
    with pytest.raises(OSError, match="none was committed"):
        store.read("gold", "Q")


def test_text_partitions(spark, store):
    for name in ("A/B", "x:y", "007", "plain", "a=b %"):
        assert store.replace_partitions(spark.range(3), "gold", "T", {"name": name}) == 3
        assert store.read_partition("gold", "T", {"name": name}).select("name").distinct().collect()[0][0] == name
    assert store.replace_partitions(spark.range(0), "gold", "T", {"name": "x:y"}) == 0
    left = {r[0] for r in store.read("gold", "T").select("name").distinct().collect()}
    assert left == {"A/B", "007", "plain", "a=b %"}
    assert store.replace_partitions(spark.range(1), "gold", "T", {"name": "007"}) == 1


def test_schema_is_kept_beside_the_table(spark, store):
    store.replace_partitions(spark.range(2), "gold", "T", {"day": date(2024, 1, 2)})
    wrong = spark.range(2).select(F.col("id").cast("string"))
    with pytest.raises(ValueError, match="columns differ.*id"):
        store.replace_partitions(wrong, "gold", "T", {"day": date(2024, 1, 1)})


def test_plan_forms_of_replace_and_retention(spark):
    days = [date(2024, 1, d) for d in (1, 2, 3)]
    history = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id long, day date")
    today = spark.createDataFrame([(9, days[2])], "id long, day date")
    assert rows(merge.replace_by_date(history, today, "day", days[2])) == [(0, days[0]), (1, days[1]), (9, days[2])]
    assert rows(merge.retain(history, "day", days[1]).select("id")) == [(1,), (2,)]


def test_keyset_pages_cover_the_table_once(spark):
    df = spark.createDataFrame([(k,) for k in (3, 5, 100, 101, 30000, 7)], "k long")
    last, seen = 0, []
    while (after := merge.next_page_key(df, "k", last, 2)) is not None:
        seen += [r["k"] for r in merge.keyset_page(df, "k", last, 2).collect()]
        last = after
    assert seen == [3, 5, 7, 100, 101, 30000]


def test_catalog_tables(spark, store):
    df = spark.range(100).select(F.col("id").alias("CustomerID"), (F.col("id") % 3).alias("v"))
    store.save_table(df, "plain_customers")
    assert store.read_table("plain_customers").count() == 100
    for name in ("left_customers", "right_customers"):
        store.save_bucketed(df, name, "CustomerID", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = store.read_table("left_customers").join(store.read_table("right_customers"), "CustomerID")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("plain_customers", "left_customers", "right_customers"):
            spark.sql(f"DROP TABLE {name}")


def test_cluster_by_key(spark):
    df = merge.cluster_by_key(spark.range(50).withColumnRenamed("id", "CustomerID"), "CustomerID")
    try:
        assert df.count() == 50
        plan = df.groupBy("CustomerID").count()._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan.split("InMemoryRelation")[0]
    finally:
        df.unpersist()


class Cluster:
    """Just what ``shared_dir`` asks a session."""

    def __init__(self, master, named=None):
        self.sparkContext = self.context = self
        self.conf, self.master, self.named, self.folder = self, master, named, None

    def get(self, key, default=None):
        return self.named if key == SETTING and self.named else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_is_the_named_one():
    named = Cluster("spark://host", "hdfs://shared/checkpoints")
    assert shared_dir(named) == "hdfs://shared/checkpoints" and named.folder is None
    assert scratch_path(named).startswith("hdfs://shared/checkpoints/scratch-")


def test_unnamed_folder_is_an_error_on_a_cluster():
    with pytest.raises(RuntimeError, match=SETTING):
        shared_dir(Cluster("yarn"))
    local = Cluster("local[2]")
    assert shared_dir(local) == local.folder


def test_durable_cuts_the_lineage(spark):
    df = durable(spark.range(3).withColumn("v", F.col("id") * 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and rows(df) == [(0, 0), (1, 2), (2, 4)]


def test_buckets_follow_the_rows_and_stay(spark, store, monkeypatch):
    from patronage.sources import store as module

    monkeypatch.setattr(module, "BUCKET_ROWS", 40)
    monkeypatch.setattr(module, "TASK_ROWS", 100)
    day = date(2020, 1, 1)
    many = lambda n: spark.range(n).select(F.col("id").alias("CustomerID"), F.lit("a").alias("Name"), F.lit(day).alias("CreatedDate"))
    store.upsert(many(2000), "gold", "P", "CustomerID", OLD)
    path = store.path("gold", "P")
    record = store._committed(path)[-1][1]
    assert record["count"] == 64 and record["bucket_rows"] == 32 and len(record["buckets"]) == 64
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join tasks this small
    try:
        store.upsert(many(40_000), "gold", "P", "CustomerID", NOW)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    record = store._committed(path)[-1][1]
    assert record["count"] == 64 and record["bucket_rows"] == 625
    files = [len([c for c in store._children(f"{path}/{v}/key_bucket={b}") if c.startswith("part")]) for b, v in record["buckets"].items()]
    assert min(files) >= 2  # a grown bucket is written by several tasks
    assert store.read("gold", "P").count() == 40_000
    assert store.upsert(people(spark, (7, "x", day)), "gold", "P", "CustomerID", NOW) < 800
    assert store.read("gold", "P").where("Name = 'x'").count() == 1


def test_lookup_reads_one_bucket(spark, store):
    day = date(2020, 1, 1)
    many = spark.range(5000).select((2 * F.col("id")).alias("CustomerID"), F.lit("a").alias("Name"), F.lit(day).alias("CreatedDate"))
    store.upsert(many, "gold", "P", "CustomerID", OLD)
    whole = store.read("gold", "P").where("CustomerID = 42")
    found = store.lookup("gold", "P", "CustomerID", 42)
    assert rows(found) == rows(whole) and found.count() == 1
    assert len(whole.inputFiles()) == 32 and len(found.inputFiles()) == 1
    assert store.lookup("gold", "P", "CustomerID", 43).count() == 0
    assert store.lookup("gold", "P", "CustomerID", None).count() == 0
    assert "PushedFilters: [IsNotNull(CustomerID), EqualTo(CustomerID,42)]" in found._jdf.queryExecution().executedPlan().toString()
    jvm = spark._jvm
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(found.inputFiles()[0]), jvm.org.apache.hadoop.conf.Configuration())
    )
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    blooms = {columns.get(k).getPath().toDotString(): columns.get(k).getBloomFilterOffset() for k in range(columns.size())}
    reader.close()
    assert blooms["CustomerID"] > 0 and blooms["Name"] < 0
    store.overwrite(many, "silver", "N")
    assert store.lookup("silver", "N", "CustomerID", 42).count() == 1
    with pytest.raises(FileNotFoundError):
        store.lookup("gold", "none", "CustomerID", 42)


def test_a_repeated_run_replaces_its_rows(spark, store):
    for run_id, n in (("a", 2), ("b", 3), ("a", 5)):
        assert store.replace_run(spark.range(n), "log", "L", run_id) == n
    counts = {r["RunID"]: r["count"] for r in store.read("log", "L").groupBy("RunID").count().collect()}
    assert counts == {"a": 5, "b": 3}
    bad = spark.range(2).select(F.when(F.col("id") == 1, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        store.replace_run(bad, "log", "L", "b")
    assert store.read("log", "L").where("RunID = 'b'").count() == 3


def test_null_and_repeated_keys_of_an_upsert(spark, store):
    day = date(2020, 1, 1)
    store.upsert(people(spark, (1, "a", day), (None, "n", day)), "gold", "P", "CustomerID", OLD)
    with pytest.raises(ValueError, match="occurs more than once"):
        store.upsert(people(spark, (None, "n", day), (None, "m", day)), "gold", "P", "CustomerID", NOW)
    assert store.upsert(people(spark), "gold", "P", "CustomerID", NOW) == 0
    assert store.read("gold", "P").count() == 2
