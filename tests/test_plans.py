"""The shape of the plans: what reaches the scan, what is shuffled, what is never done."""

import re
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from patronage.operators import merge
from patronage.operators import transactions as txn
from patronage.plans import layers
from patronage.queries import DATA_DATE, EARLIER_DATE, Workspace, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def work(spark):
    return Workspace(spark, FOLDER)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text, table):
    return [one for one in re.findall(r"FileScan [^\n]*", text) if f"/{table}.parquet" in one]


def test_lines_are_read_and_joined_once(work):
    text = plan(txn.purchase_totals(work.facts, work.table("Products")))
    assert len(scans(text, "lineitem")) == 1 and len(scans(text, "orders")) == 1
    assert text.count("Expand") == 1


def test_filters_and_columns_reach_the_scan(work):
    layers.ingest_bronze(work.store, work.source, "Orders", work.p)
    orders = layers.read_slice(work.store, "bronze", "dbo.Orders", work.p)
    text = plan(txn.line_facts(orders, work.table("OrderDetails")))
    assert "EqualTo(Status,Completed)" in text and "IsNotNull(OrderID)" in text
    (lines,) = scans(plan(work.order_summary()), "lineitem")
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_extendedprice", lines)
    (people,) = scans(plan(queries()["q_customer_lookup"](work.spark, FOLDER)), "customer")[:1]
    assert "EqualTo(c_custkey,42)" in people


def test_slice_lists_one_folder(work):
    for day in (EARLIER_DATE, DATA_DATE):
        layers.ingest_bronze(work.store, work.source, "Orders", replace(work.p, data_date=day))
    text = plan(layers.read_slice(work.store, "bronze", "dbo.Orders", work.p))
    assert re.search(r"Location: InMemoryFileIndex\(1 paths\)\[[^]]*_ingestion_date=2001-08-02\]", text)
    whole = work.store.read("bronze", "dbo.Orders", F.col("_ingestion_date") == F.lit(DATA_DATE))
    assert re.search(r"PartitionFilters: \[[^]]*_ingestion_date[^]]* = 2001-08-02", plan(whole))
    with pytest.raises(FileNotFoundError, match="_ingestion_date=2000-01-01"):
        layers.read_slice(work.store, "bronze", "dbo.Orders", replace(work.p, data_date=date(2000, 1, 1)))


def test_partition_write_does_not_sort(work):
    layers.ingest_bronze(work.store, work.source, "Orders", work.p)
    runs = work.spark._jsparkSession.sharedState().statusStore().executionsList()
    writes = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    mine = [w for w in writes if "InsertIntoHadoopFsRelationCommand" in w and work.store.base in w]
    assert mine and all("Sort" not in w for w in mine)


def test_scores_need_no_window_and_no_join(work):
    text = plan(work.scored)
    assert "Window" not in text and "SinglePartition" not in text and "Join" not in text and "Exchange" not in text


def test_top_per_customer_limits_before_the_shuffle(work):
    text = plan(txn.top_product(work.facts, work.table("Products")))
    assert text.count("WindowGroupLimit") == 2


def test_page_is_a_bounded_sort(work):
    assert "TakeOrderedAndProject" in plan(merge.keyset_page(work.table("Orders"), "OrderID", 10, 5))


def test_busy_customers_are_spread_by_order(work, no_broadcast):
    text = plan(txn.purchase_totals(work.facts, work.table("Products")))
    assert re.search(r"hashpartitioning\(CustomerID#\d+L?, OrderID#\d+L?, Listed", text)


def test_order_summary_combines_lines_before_the_shuffle(work, no_broadcast):
    text = plan(work.order_summary())
    exchanges = re.findall(r"Exchange (hashpartitioning\(\w+#\d+L?)", text)
    assert len(exchanges) == 3  # orders and summed lines by OrderID, then customers
    assert re.search(r"Exchange hashpartitioning\(OrderID#\d+L?, \d+\)[^\n]*\n[^\n]*HashAggregate\([^\n]*partial_sum", text)


def test_an_order_with_most_lines_is_split(spark, no_broadcast):
    """One order holds a third of all lines: the join on OrderID must not leave them to one task."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        n = 300_000
        lines = spark.range(0, n, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("OrderID"),
            (F.col("id") % 50).alias("ProductID"),
            F.lit(1).cast("decimal(15,2)").alias("Quantity"),
            F.lit(2).cast("decimal(15,2)").alias("UnitPrice"),
            F.lit(0).cast("decimal(4,2)").alias("Discount"),
        )
        orders = spark.range(0, n, 1, 8).select(
            F.col("id").alias("OrderID"),
            (F.col("id") % 100).alias("CustomerID"),
            F.lit("2024-01-01").cast("date").alias("OrderDate"),
            F.lit("Completed").alias("Status"),
        )
        products = spark.range(50).selectExpr("id ProductID", "'c' Category", "'n' ProductName")
        totals = txn.purchase_totals(txn.line_facts(orders, lines), products)
        rows = totals.collect()
        assert "skew=true" in plan(totals)
        assert sum(r["TotalSpent"] for r in rows) == 2 * n
        plain = txn.order_summary(orders, lines)
        assert totals.select(*plain.columns).exceptAll(plain).isEmpty()
    finally:
        for key in settings:
            spark.conf.unset(key)
