from dataclasses import replace
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from frames import DAY, address, customer, days_ago, line, sources
from pyspark.sql import functions as F

from patronage.contracts import SOURCES, conform, require
from patronage.operators import quality, segments
from patronage.operators.customers import BASE_COLUMNS
from patronage.operators.metrics import customer_metrics
from patronage.operators.transactions import SUMMARY_COLUMNS
from patronage.params import INCREMENTAL, RunParams
from patronage.plans import layers, run, runlog

P = RunParams(data_date=DAY, high_value_threshold=Decimal("100"), started_at=datetime(2024, 7, 1))
LAYER_TABLES = ("CustomerMetrics", "CustomerSegments")


def tables(spark):
    people = range(1, 9)
    return sources(
        spark,
        customers=[customer(i, changed=DAY if i == 3 else days_ago(400)) for i in people],
        addresses=[address(i) for i in people if i != 2],
        contacts=[(1, days_ago(5)), (4, DAY)],
        orders=[(i * 10 + k, i, days_ago(i * 29 + k), "Completed") for i in people if i != 8 for k in range(i % 4 + 1)],
        lines=[line(i * 10 + k, 100 + i % 2, "1", f"{i * 13}.00") for i in people for k in range(4)],
        products=[(100, "A", "axle"), (101, "B", "bolt")],
        returns=[(1, 1), (2, 5)],
    )


@pytest.fixture(scope="module")
def source(spark):
    return layers.Frames(tables(spark))


def content(df, *without):
    return sorted(map(tuple, df.drop(*without).select(sorted(set(df.columns) - set(without))).collect()), key=repr)


@pytest.fixture(scope="module")
def finished(spark, source, tmp_path_factory):
    from patronage.sources.store import TableStore

    store = TableStore(spark, str(tmp_path_factory.mktemp("run")))
    return store, run.run(store, source, replace(P, debug_mode=True))


def test_report(finished, spark):
    store, report = finished
    assert report["status"] == "Success" and report["error"] is None
    assert {k: v["status"] for k, v in report["layers"].items()} == dict.fromkeys(("bronze", "silver", "gold"), "Success")
    saved = spark.read.json(store.path("log", f"report_{DAY}_FULL")).first()
    assert saved["status"] == "Success" and len(saved["layers"]) == 3


def test_tables_of_all_layers(finished):
    store, _ = finished
    for name in SOURCES:
        assert store.read("bronze", f"dbo.{name}").where(F.col("_ingestion_date") == F.lit(DAY)).count() > 0
    assert set(BASE_COLUMNS) <= set(store.read("silver", "CustomerBase").columns)
    assert store.read("silver", "CustomerBase").count() == 8
    assert set(SUMMARY_COLUMNS) <= set(store.read("silver", "TransactionSummary").columns)
    for name in LAYER_TABLES:
        assert store.read("gold", name).count() == 7
    analytics = store.read("gold", "CustomerAnalytics")
    assert analytics.count() == 7 and {r["ProcessDate"] for r in analytics.collect()} == {DAY}
    profiles = store.read("gold", "CustomerProfiles")
    assert profiles.count() == 8 and len(profiles.columns) == 24
    assert profiles.where("TotalOrders IS NULL").count() == 1


def test_gold_equals_the_joined_operators(finished):
    """The run computes segments without joins; the public operators join stored tables."""
    store, _ = finished
    base, summary = (layers.read_slice(store, "silver", n, P) for n in ("CustomerBase", "TransactionSummary"))
    metrics = customer_metrics(summary, P)
    joined = segments.customer_segments(base, metrics, summary, P)
    assert content(layers.read_slice(store, "gold", "CustomerSegments", P)) == content(joined)
    analytics = segments.customer_analytics(metrics, joined, P)
    stored = store.read("gold", "CustomerAnalytics")
    assert content(stored, "_gold_process_date", "_gold_process_timestamp") == content(analytics)
    counts = segments.analytics_summary(base, metrics, joined, P).first()
    row = store.read("gold", "CustomerAnalyticsSummary").first()
    assert all(row[c] == counts[c] for c in counts.asDict())
    assert row["ProcessingStatus"] == "Success" and row["TotalCustomers"] == 7


def test_step_log(finished):
    store, _ = finished
    steps = runlog.show(store).collect()
    assert [s["LogID"] for s in steps] == list(range(1, 9))
    assert {s["StepName"]: s["RowCount"] for s in steps if s["StepName"] != "Bronze Ingestion"} == {
        "Initialize": 0,
        "Extract Customer Base": 8,
        "Process Transaction Summary": 7,
        "Calculate Customer Metrics": 7,
        "Customer Segmentation": 7,
        "Data Persistence": 7,
        "Generate Summary": 1,
    }
    assert steps[0]["Message"] == "Starting Customer Analytics processing for date: 2024-06-30 - Type: FULL"


def test_same_date_again_changes_nothing_but_logs(source, store):
    run.run(store, source, P)
    names = ("CustomerMetrics", "CustomerSegments", "CustomerAnalytics", "CustomerProfiles")
    before = {n: content(store.read("gold", n)) for n in names}
    run.run(store, source, P)
    assert {n: content(store.read("gold", n)) for n in names} == before
    assert store.read("gold", "CustomerAnalyticsSummary").count() == 2


def test_dates_and_retention(source, store):
    earlier = [DAY - timedelta(days=n) for n in (366, 365, 1)]
    for day in earlier:
        run.run(store, source, replace(P, data_date=day, debug_mode=True))
    run.run(store, source, replace(P, debug_mode=True))
    assert store.read("gold", "CustomerAnalytics").select("ProcessDate").distinct().count() == 4
    run.run(store, source, P)
    kept = {r[0] for r in store.read("gold", "CustomerAnalytics").select("ProcessDate").distinct().collect()}
    assert kept == {*earlier[1:], DAY}
    assert quality.retention(store.read("gold", "CustomerAnalytics"), "ProcessDate", P.retention_cutoff).first()["passed"]


def test_incremental_run_updates_some_profiles(source, store):
    run.run(store, source, P)
    later = datetime(2024, 7, 2)
    run.run(store, source, replace(P, process_type=INCREMENTAL, started_at=later))
    stamped = {r["CustomerID"]: r["ModifiedDate"] for r in store.read("gold", "CustomerProfiles").collect()}
    assert {k for k, v in stamped.items() if v == later} == {3, 4} and len(stamped) == 8
    assert store.read("gold", "CustomerAnalytics").count() == 2


def test_empty_sources(spark, store):
    nobody = layers.Frames(sources(spark))
    assert run.run(store, nobody, P)["status"] == "Success"
    row = store.read("gold", "CustomerAnalyticsSummary").first()
    assert (row["TotalCustomers"], row["ChurningCustomers"], row["AverageLifetimeValue"]) == (0, 0, Decimal("0.00"))


def test_failed_run_is_recorded_and_raised(spark, store):
    twice = tables(spark)
    twice["Customers"] = twice["Customers"].unionAll(twice["Customers"].where("CustomerID = 5"))
    with pytest.raises(ValueError, match="CustomerID 5 occurs more than once"):
        run.run(store, layers.Frames(twice), P)
    row = store.read("gold", "CustomerAnalyticsSummary").first()
    assert (row["ProcessingStatus"], row["TotalCustomers"]) == ("Failed", 0)
    assert row["ErrorMessage"] == "CustomerID 5 occurs more than once at step Extract Customer Base"
    last = runlog.show(store).collect()[-1]
    assert last["RowCount"] == -1 and last["Message"].startswith("ERROR: CustomerID 5")
    assert not store.exists("gold", "CustomerProfiles")


def test_missing_input_is_named(spark, store):
    some = tables(spark)
    del some["Returns"], some["Products"]
    with pytest.raises(ValueError, match="Missing required inputs: Returns, Products"):
        require(some, "Orders", "Returns", "Products")
    with pytest.raises(ValueError, match="Missing required inputs: Products"):
        run.run(store, layers.Frames(some), P)


def test_contracts(spark):
    wide = spark.createDataFrame([(1, 2, "x")], "ReturnID int, CustomerID int, Extra string")
    assert conform(wide, "Returns").dtypes == [("ReturnID", "bigint"), ("CustomerID", "bigint")]
    with pytest.raises(ValueError, match="Returns lacks columns: CustomerID"):
        conform(wide.drop("CustomerID"), "Returns")
    lines = spark.createDataFrame([(1, 2, 1, 0)], "OrderID int, ProductID int, Quantity int, Discount int")
    with pytest.raises(ValueError, match="OrderDetails lacks columns: UnitPrice"):
        conform(lines, "OrderDetails")


def test_command_line(tmp_path):
    args = run.arguments().parse_args(
        ["--store", str(tmp_path), "--star-schema", "/x", "--process-date", "2024-06-30", "--process-type", "INCREMENTAL"]
        + ["--debug", "--retention-days", "9", "--high-value-threshold", "12.50", "--churn-days-low", "3"]
    )
    p = run.params(args)
    assert (p.data_date, p.process_type, p.debug_mode, p.retention_days) == (DAY, "INCREMENTAL", True, 9)
    assert (p.high_value_threshold, p.churn_days_low, p.churn_days_high) == (Decimal("12.50"), 3, 90)
    yesterday = run.params(run.arguments().parse_args(["--store", "s", "--star-schema", "/x"])).data_date
    assert (datetime.now().date() - yesterday).days in (1, 2)


def test_command_line_run(spark, tmp_path):
    argv = ["--store", str(tmp_path), "--star-schema", "/root/testdata/sf0.001", "--process-date", "2001-08-02"]
    assert run.main(argv) == 0
    assert run.main([*argv[:3], "/nowhere", *argv[4:]]) == 1
