"""Every operator as a query over a folder of star schema tables.

``queries()`` maps names to callables of (spark, folder). Results are portable: decimals come out as
doubles, dates as yyyy-MM-dd text and integers as bigint, so other engines can be compared with them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.contracts import SOURCES
from patronage.functions import rules
from patronage.functions import fixed_values as fx
from patronage.functions.columns import date_text
from patronage.operators import customers as cust
from patronage.operators import merge, messages, metrics, paging, purchase_state, quality, scripts, segments, variants
from patronage.operators import transactions as txn
from patronage.operators.ntile import By, ntile_global
from patronage.params import FULL, INCREMENTAL, RunParams
from patronage.plans import layers, runlog
from patronage.plans.run import REPORT_SCHEMA, run
from patronage.sources import batches
from patronage.sources.durable import durable, scratch_path
from patronage.sources.star_schema import StarSchema
from patronage.sources.store import TableStore

DATA_DATE = date(2001, 8, 2)
CHANGED_SINCE = date(2001, 7, 1)
EARLIER_DATE = date(2001, 1, 1)
EARLIEST_DATE = date(2000, 6, 1)
HIGH_VALUE = Decimal("1000000.00")
RUN_MOMENT = datetime(2001, 8, 2, 12, 0, 0)
LOOKUP_ID = 42
PAGE_AFTER, PAGE_SIZE = 500, 100
CATALOG_BUCKETS = 8
SAMPLE_SIZE = 5
FALLBACKS = {
    "business": ("system", "assistant"),
    "technical": ("assistant", "system", "user"),
    "guidance": ("system", "user"),
}
ROLE_STAGES = {"system": "bronze_layer", "user": "silver_layer", "assistant": "gold_layer"}

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Callable[["Workspace"], DataFrame]] = {}


class Workspace:
    """Frames of one folder, built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.source = StarSchema(spark, folder)
        self.p = RunParams(data_date=DATA_DATE, high_value_threshold=HIGH_VALUE, started_at=RUN_MOMENT)
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.source.table(name)
        return self._tables[name]

    def base(self, p: RunParams | None = None) -> DataFrame:
        people = (self.table(n) for n in ("Customers", "CustomerAddresses", "CustomerInteractions"))
        return cust.customer_base(*people, p or self.p)

    @cached_property
    def facts(self) -> DataFrame:
        return txn.line_facts(self.table("Orders"), self.table("OrderDetails"))

    def order_summary(self) -> DataFrame:
        return txn.order_summary(self.table("Orders"), self.table("OrderDetails"))

    @cached_property
    def all_lines(self) -> DataFrame:
        return txn.order_lines(self.table("Orders"), self.table("OrderDetails"))

    def summary(self, p: RunParams | None = None, before: date | None = None) -> DataFrame:
        """The transaction summary, of the orders before a date where one is given."""
        orders = self.table("Orders")
        if before is not None:
            orders = orders.where(F.col("OrderDate") < F.lit(before))
        p = p or self.p
        # The base of a full run holds every customer, so their ids alone say the same.
        members = self.base(p) if p.process_type == INCREMENTAL else self.source.customer_ids()
        rest = (self.table(n) for n in ("OrderDetails", "Products", "Returns"))
        return txn.transaction_summary(members, orders, *rest, p)

    @cached_property
    def stored_summary(self) -> DataFrame:
        """The summary as the gold layer finds it: computed once."""
        return durable(self.summary())

    @cached_property
    def metrics(self) -> DataFrame:
        return metrics.customer_metrics(self.stored_summary, self.p)

    @cached_property
    def segments(self) -> DataFrame:
        return segments.customer_segments(self.base(), self.metrics, self.stored_summary, self.p)

    @cached_property
    def scored(self) -> DataFrame:
        return segments.scored_customers(self.stored_summary, self.p)

    @cached_property
    def store(self) -> TableStore:
        return TableStore(self.spark, scratch_path(self.spark))

    def run(self, process_type: str) -> tuple[TableStore, RunParams]:
        """The whole run into a store of its own; an incremental one of what changed since the middle of the data."""
        day = CHANGED_SINCE if process_type == INCREMENTAL else DATA_DATE
        p = replace(self.p, process_type=process_type, data_date=day)
        store = TableStore(self.spark, scratch_path(self.spark))
        run(store, self.source, p)
        return store, p

    def history(self) -> DataFrame:
        """Analytics-like rows of three process dates: one row per order, dated by its status."""
        day = (
            F.when(F.col("Status") == fx.COMPLETED_STATUS, F.lit(EARLIEST_DATE))
            .when(F.col("Status") == "Open", F.lit(EARLIER_DATE))
            .otherwise(F.lit(DATA_DATE))
        )
        return self.table("Orders").select("OrderID", "CustomerID", day.alias("ProcessDate"))


def portable(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = date_text(column)
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(build: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    _REGISTRY[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    def runner(build: Callable[[Workspace], DataFrame]) -> Query:
        return lambda spark, folder: portable(build(Workspace(spark, folder)))

    return {name: runner(build) for name, build in _REGISTRY.items()}


# Customers


@query
def q_last_contact(w):
    return cust.last_contact(w.table("CustomerInteractions"))


@query
def q_last_contact_window(w):
    return cust.last_contact_by_window(w.table("CustomerInteractions"))


@query
def q_customer_base(w):
    return w.base()


@query
def q_customer_base_incremental(w):
    return w.base(replace(w.p, process_type=INCREMENTAL, data_date=CHANGED_SINCE))


@query
def q_customer_base_sql(w):
    people = (w.table(n) for n in ("Customers", "CustomerAddresses", "CustomerInteractions"))
    return cust.customer_base_sql(*people, w.p)


@query
def q_customer_lookup(w):
    return cust.customer_lookup(w.base(), LOOKUP_ID)


@query
def q_customer_order_stats(w):
    return cust.customer_order_stats(w.table("Customers"), w.source.order_totals(), "OrderTotal")


# Transactions


@query
def q_order_summary(w):
    return w.order_summary()


@query
def q_category_spend(w):
    return txn.category_spend(w.facts, w.table("Products"))


@query
def q_product_quantity(w):
    return txn.product_quantity(w.facts, w.table("Products"))


@query
def q_top_category(w):
    return txn.top_category(w.facts, w.table("Products"))


@query
def q_top_product(w):
    return txn.top_product(w.facts, w.table("Products"))


@query
def q_return_rate(w):
    return txn.return_rate(w.table("Returns"), w.order_summary(), w.p)


@query
def q_transaction_summary(w):
    return w.summary()


@query
def q_transaction_summary_incremental(w):
    return w.summary(replace(w.p, process_type=INCREMENTAL, data_date=CHANGED_SINCE))


def _slices(w: Workspace) -> list[layers.Frames]:
    """The source as two deliveries: orders before a date with their lines and returns, and those since."""
    out = []
    for early in (True, False):
        day = F.col("OrderDate") < F.lit(EARLIER_DATE)
        orders = w.table("Orders").where(day if early else ~day)
        ids = orders.select("OrderID")
        parts = {
            "Orders": orders,
            "OrderDetails": w.table("OrderDetails").join(ids, "OrderID", "left_semi"),
            "Returns": w.table("Returns").join(ids, F.col("ReturnID") == F.col("OrderID"), "left_semi"),
        }
        out.append(layers.Frames({name: parts[name] if name in parts else w.table(name) for name in SOURCES}))
    return out


def _state_runs(w: Workspace) -> layers.PurchaseStates:
    """A full run of the first delivery, and an incremental one that reads only the second."""
    kinds = (replace(w.p, data_date=EARLIER_DATE), replace(w.p, process_type=INCREMENTAL))
    for frames, p in zip(_slices(w), kinds):
        p = replace(p, keep_state=True)
        names = ("Orders", "OrderDetails", "Returns")
        bronze = [layers.ingest_bronze(w.store, frames, name, p)[1] for name in names]
        layers.PurchaseStates(w.store).put(purchase_state.purchase_state(*bronze), p)
    return layers.PurchaseStates(w.store)


@query
def q_summary_from_state(w):
    """The summary of all customers after two deliveries, from the stored sums alone."""
    state = _state_runs(w).read()
    return purchase_state.summary_from_state(state, w.source.customer_ids(), w.table("Products"), w.p)


@query
def q_purchase_state(w):
    """The stored sums themselves, the second delivery added to the first."""
    states = _state_runs(w)
    states.compact(DATA_DATE)
    return states.read()


# Metrics


@query
def q_churn(w):
    return w.summary().select("CustomerID", rules.churn_probability(w.p).alias("ChurnProbability"))


@query
def q_propensity(w):
    return w.summary().select("CustomerID", rules.purchase_propensity(w.p).alias("NextPurchasePropensity"))


@query
def q_loyalty(w):
    return w.summary().select("CustomerID", rules.loyalty_exact(w.p).cast(w.p.rate_type).alias("LoyaltyIndex"))


@query
def q_clv(w):
    value = rules.lifetime_value(rules.churn_probability(w.p), w.p)
    return w.summary().select("CustomerID", value.alias("CustomerLifetimeValue"))


@query
def q_rfm_scores(w):
    return metrics.rfm_scores(w.stored_summary, w.p)


@query
def q_rfm_five_is_best(w):
    return metrics.rfm_scores(w.stored_summary, replace(w.p, score_orientation="five_is_best"))


@query
def q_customer_metrics(w):
    return w.metrics


# Segments


@query
def q_value_segment(w):
    return w.scored.select("CustomerID", "CustomerLifetimeValue", "ValueSegment")


@query
def q_behavior_segment(w):
    return w.scored.select("CustomerID", *metrics.SCORES, "RFMScore", "BehaviorSegment")


@query
def q_lifecycle_segment(w):
    return w.scored.select("CustomerID", "LifecycleSegment")


@query
def q_target_group(w):
    return w.scored.select("CustomerID", "TargetGroup")


@query
def q_recommendation(w):
    return w.scored.select("CustomerID", "MarketingRecommendation")


@query
def q_customer_segments(w):
    return w.segments


@query
def q_customer_analytics(w):
    """As the run builds it: one projection over the stored summary."""
    return w.scored.withColumn("ProcessDate", F.lit(DATA_DATE)).select(*segments.ANALYTICS_COLUMNS)


@query
def q_customer_analytics_joined(w):
    """From separate metric and segment tables."""
    return segments.customer_analytics(w.metrics, w.segments, w.p)


@query
def q_analytics_summary(w):
    return segments.summarize(w.scored, w.p)


@query
def q_analytics_summary_joined(w):
    """From separate base, metric and segment tables."""
    return segments.analytics_summary(w.base(), w.metrics, w.segments, w.p)


@query
def q_customer_profile(w):
    return segments.customer_profile(w.base(), w.summary())


@query
def q_customer_wide(w):
    return segments.customer_wide(w.base(), w.stored_summary, w.metrics)


@query
def q_rfm_wide(w):
    return segments.rfm_wide(w.metrics, w.stored_summary)


# Variants


@query
def q_segments_simple_a(w):
    return segments.simple_segments(w.summary(), w.base(), "a")


@query
def q_segments_simple_b(w):
    return segments.simple_segments(w.summary(), w.base(), "b")


@query
def q_segments_simple_c(w):
    return segments.two_way_segments(w.scored)


@query
def q_line_grain_summary(w):
    return _two_digits(variants.line_grain_summary(w.all_lines, DATA_DATE))


@query
def q_line_avg_summary(w):
    return _two_digits(variants.line_average_summary(w.all_lines, DATA_DATE))


@query
def q_rfm_line_grain(w):
    scored = variants.rfm_line_grain(durable(variants.line_grain_summary(w.all_lines, DATA_DATE)))
    return scored.select("CustomerID", *metrics.SCORES, "RFMScore")


@query
def q_rfm_from_orders(w):
    return variants.rfm_from_orders(durable(variants.rfm_inputs(w.source.order_totals(), "OrderTotal", DATA_DATE)))


def _two_digits(df: DataFrame) -> DataFrame:
    return df.withColumn("AvgOrderValue", F.col("AvgOrderValue").cast("decimal(24,2)"))


# Table maintenance


@query
def q_bronze_orders(w):
    layers.ingest_bronze(w.store, w.source, "Orders", w.p)
    return w.store.read("bronze", "dbo.Orders").drop("_ingestion_timestamp")


@query
def q_bronze_slice(w):
    """Two ingests on different dates; the later date's slice alone."""
    orders = w.table("Orders")
    early = layers.Frames({"Orders": orders.where(F.col("OrderDate") < F.lit(EARLIER_DATE))})
    late = layers.Frames({"Orders": orders.where(F.col("OrderDate") >= F.lit(EARLIER_DATE))})
    layers.ingest_bronze(w.store, early, "Orders", replace(w.p, data_date=EARLIER_DATE))
    layers.ingest_bronze(w.store, late, "Orders", w.p)
    return layers.read_slice(w.store, "bronze", "dbo.Orders", w.p)


@query
def q_bronze_evolved(w):
    """Two ingests of orders whose source changed in between: a column went, one came, one got decimals. All rows."""
    orders = w.table("Orders").join(w.source.order_totals().select("OrderID", "OrderTotal"), "OrderID")
    early = orders.where(F.col("OrderDate") < F.lit(EARLIER_DATE)).withColumn("OrderTotal", F.col("OrderTotal").cast("int"))
    late = orders.where(F.col("OrderDate") >= F.lit(EARLIER_DATE)).withColumn("Level", F.col("OrderID") % 5)
    p = replace(w.p, all_source_columns=True)
    tagged = early.withColumn("Tag", F.concat(F.lit("T"), F.col("OrderID") % 7))
    layers.ingest_bronze(w.store, layers.Frames({"Orders": tagged}), "Orders", replace(p, data_date=EARLIER_DATE))
    layers.ingest_bronze(w.store, layers.Frames({"Orders": late}), "Orders", p)
    return w.store.read("bronze", "dbo.Orders").drop("_ingestion_timestamp")


@query
def q_profile_merge(w):
    """Profiles as of an earlier date, for the customers of that time, then merged with today's."""
    then = datetime(EARLIER_DATE.year, EARLIER_DATE.month, EARLIER_DATE.day, 12)
    known = w.base().where(F.col("CreatedDate") < F.lit(EARLIEST_DATE))
    earlier = segments.customer_profile(known, w.summary(replace(w.p, data_date=EARLIER_DATE), EARLIER_DATE))
    earlier = durable(earlier)
    w.store.upsert(earlier, "gold", "CustomerProfiles", "CustomerID", then, keep=("CreatedDate",))
    changed = replace(w.p, process_type=INCREMENTAL, data_date=CHANGED_SINCE)
    today = durable(segments.customer_profile(w.base(changed), w.summary(changed)))
    w.store.upsert(today, "gold", "CustomerProfiles", "CustomerID", RUN_MOMENT, keep=("CreatedDate",))
    merged = w.store.read("gold", "CustomerProfiles")
    # Named by the two moments, so that the session's time zone plays no part.
    stamp = F.col("ModifiedDate")
    day = F.when(stamp == F.lit(then), F.lit(EARLIER_DATE)).when(stamp == F.lit(RUN_MOMENT), F.lit(DATA_DATE))
    return merged.withColumn("ModifiedDate", day)


@query
def q_profile_lookup(w):
    """One customer's stored profile, from the one bucket that can hold it."""
    profiles = durable(segments.customer_profile(w.base(), w.summary()))
    w.store.upsert(profiles, "gold", "CustomerProfiles", "CustomerID", RUN_MOMENT, keep=("CreatedDate",))
    return w.store.lookup("gold", "CustomerProfiles", "CustomerID", LOOKUP_ID).drop("ModifiedDate")


@query
def q_replace_by_date(w):
    """A date's rows written twice: the second write replaces the first and leaves other dates alone."""
    _store_history(w)
    again = w.history().where(F.col("ProcessDate") == F.lit(DATA_DATE)).withColumn("OrderID", -F.col("OrderID"))
    w.store.replace_partitions(again, "gold", "History", {"ProcessDate": DATA_DATE})
    return w.store.read("gold", "History")


@query
def q_retention(w):
    _store_history(w)
    cutoff = replace(w.p, retention_days=365).retention_cutoff
    w.store.drop_before("gold", "History", "ProcessDate", cutoff)
    return w.store.read("gold", "History")


@query
def q_retention_plan(w):
    """The same rule as a plan over rows, strict at the cutoff itself."""
    return merge.retain(w.history(), "ProcessDate", EARLIER_DATE)


def _store_history(w: Workspace) -> None:
    for day in (EARLIEST_DATE, EARLIER_DATE, DATA_DATE):
        rows = w.history().where(F.col("ProcessDate") == F.lit(day))
        w.store.replace_partitions(rows, "gold", "History", {"ProcessDate": day})


@query
def q_keyset_page(w):
    return merge.keyset_page(w.base(), "CustomerID", PAGE_AFTER, PAGE_SIZE)


@query
def q_keyset_batches(w):
    """Every customer with the number of the page it is on."""
    return paging.pages(w.base(), "CustomerID", PAGE_SIZE).numbered()


@query
def q_keyset_written(w):
    """The customers written in batches that stop after some, and go on after the marker."""
    base = durable(w.base())

    def stop(batch: int, rows: int) -> None:
        if batch == 1:
            raise InterruptedError

    try:
        batches.write_in_batches(w.store, base, "gold", "Customers", "CustomerID", PAGE_SIZE, stop)
    except InterruptedError:
        batches.write_in_batches(w.store, base, "gold", "Customers", "CustomerID", PAGE_SIZE)
    return w.store.read("gold", "Customers").select("CustomerID", F.col("Batch").alias("page"))


@query
def q_page_markers(w):
    """The last key of each page by asking for one page after the other, which writers of one batch at a time do."""
    customers, last, found = paging.KeyOrder(w.table("Customers"), "CustomerID"), -1, []
    while (last := merge.next_page_key(customers, "CustomerID", last, 10 * PAGE_SIZE)) is not None:
        found.append((len(found), last))
    return w.spark.createDataFrame(found, "page bigint, last_key bigint")


@query
def q_bucketed_join(w):
    """Customers and their orders from two catalog tables that lie in the same buckets."""
    names = [f"patronage_{uuid.uuid4().hex}" for _ in "ab"]
    frames = w.base(), w.table("Orders").where(F.col("CustomerID").isNotNull())
    for name, df in zip(names, frames):
        w.store.save_bucketed(df, name, "CustomerID", CATALOG_BUCKETS, scratch_path(w.spark))
    base, orders = (w.store.read_table(name) for name in names)
    counted = orders.groupBy("CustomerID", "Status").agg(F.count(F.lit(1)).alias("Orders"), F.max("OrderDate").alias("OrderDate"))
    return base.select("CustomerID", "CustomerName", "State").join(counted, "CustomerID")


# Checks


@query
def q_dq_row_counts(w):
    for name in SOURCES:
        layers.ingest_bronze(w.store, w.source, name, w.p)
    return quality.row_counts(
        {n: (w.table(n), layers.read_slice(w.store, "bronze", f"dbo.{n}", w.p)) for n in SOURCES}
    )


@query
def q_dq_schema(w):
    """Columns of each source's stored tables beside the contract, with an order table that lacks and renames some,
    and how many rows each source has."""
    differing, rows = [], []
    for name, contract in SOURCES.items():
        df = w.table(name)
        if name == "Orders":
            df = df.withColumn("OrderDate", F.col("OrderDate").cast("timestamp")).withColumnRenamed("Status", "State")
        named = F.lit(name).alias("table_name")
        rows.append(df.agg(F.count(F.lit(1)).alias("source_rows")).select(named, "source_rows"))
        differing.append(quality.schema_differences(df, contract.schema, contract.optional).select(named, "*"))
    return reduce(DataFrame.unionAll, differing).join(reduce(DataFrame.unionAll, rows), "table_name")


@query
def q_dq_segment_domain(w):
    return quality.segment_domains(w.segments)


@query
def q_dq_retention(w):
    return quality.retention(w.history(), "ProcessDate", EARLIER_DATE)


@query
def q_dq_no_orders(w):
    return quality.without_orders(w.base(), w.summary())


@query
def q_dq_expected_values(w):
    """Completed orders and spend per customer against all orders and their spend: every customer that differs.

    Spend is given with other digits than the summary's, which is no difference.
    """
    expected = w.all_lines.groupBy("CustomerID").agg(
        F.countDistinct("OrderID").alias("TotalOrders"), F.sum("NetAmount").cast("decimal(30,8)").alias("TotalSpent")
    )
    found = quality.expected_values(w.order_summary(), expected, "CustomerID")
    number = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
    return found.select("CustomerID", "present", "column_name", number("expected"), number("actual"))


@query
def q_dq_reconcile(w):
    orders = w.table("Orders")
    return quality.reconcile(orders.where(F.col("OrderDate") < F.lit(EARLIER_DATE)), orders)


@query
def q_dq_reconcile_by_key(w):
    """Orders against a copy in which some are lost and some have another status, compared where the sums differ."""
    orders = w.table("Orders")
    status = F.when(F.col("OrderID") % 97 == 0, "Changed").otherwise(F.col("Status"))
    copy = orders.where(F.col("OrderID") % 101 != 0).withColumn("Status", status)
    return quality.reconcile_by_key(orders, copy, "OrderID")


@query
def q_dq_sample(w):
    """Customers drawn from every segment, with what all their orders come to where the summary says otherwise."""
    members = w.scored.select("CustomerID", "BehaviorSegment")
    sample = durable(quality.stratified_sample(members, "BehaviorSegment", "CustomerID", SAMPLE_SIZE))
    lines = w.all_lines.join(sample, "CustomerID", "left_semi")
    expected = lines.groupBy("CustomerID").agg(F.countDistinct("OrderID").alias("TotalOrders"), F.max("OrderDate").alias("LastPurchaseDate"))
    found = quality.expected_values(w.order_summary(), expected, "CustomerID")
    differing = found.groupBy("CustomerID").agg(F.count(F.lit(1)).alias("differences"), F.max(F.when(F.col("column_name") == "TotalOrders", F.col("expected"))).alias("orders"))
    return sample.join(differing, "CustomerID", "left").select("CustomerID", "BehaviorSegment", F.coalesce("differences", F.lit(0)).alias("differences"), F.coalesce("orders", F.lit("")).alias("orders"))


# Rankings with unknown keys, favourites with unknown amounts


@query
def q_ntile_null_keys(w):
    """Tiles of events by value, where every third value is unknown, both ways round."""
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    events = durable(w.source.raw("events").select("event_id", value.alias("value")))
    rankings = {"up": By(F.col("value")), "down": By(F.col("value"), descending=True)}
    return ntile_global(events, rankings, 5, "event_id").select("event_id", "up", "down")


@query
def q_null_favourites(w):
    """Favourites where the discount of every third order is unknown."""
    unknown = F.when(F.col("OrderID") % 3 != 0, F.col("Discount"))
    lines = txn.line_facts(w.table("Orders"), w.table("OrderDetails").withColumn("Discount", unknown))
    totals = txn.purchase_totals(lines, w.table("Products"))
    return totals.select("CustomerID", "TotalOrders", "TotalSpent", "TopCategory", "TopProduct")


# The whole run


def _run_analytics(w, process_type):
    store, _ = w.run(process_type)
    return store.read("gold", "CustomerAnalytics").select(*segments.ANALYTICS_COLUMNS)


@query
def q_run_analytics(w):
    return _run_analytics(w, FULL)


@query
def q_run_analytics_incremental(w):
    return _run_analytics(w, INCREMENTAL)


@query
def q_run_summary(w):
    rows = [w.run(kind)[0].read("gold", "CustomerAnalyticsSummary") for kind in (FULL, INCREMENTAL)]
    return rows[0].unionByName(rows[1]).drop("TotalProcessingTimeMs", "RunID")


class Broken:
    """A source in which one product is listed twice, which the run finds when it comes to the products."""

    def __init__(self, source):
        self.source = source

    def table(self, name: str) -> DataFrame:
        df = self.source.table(name)
        return df.unionByName(df.orderBy("ProductID").limit(1)) if name == "Products" else df


def _failed_run(w: Workspace, run_id: str) -> TableStore:
    store = TableStore(w.spark, scratch_path(w.spark))
    try:
        run(store, Broken(w.source), replace(w.p, run_id=run_id))
    except ValueError:
        return store
    raise RuntimeError("the run did not fail")


@query
def q_run_failed(w):
    """What a failed run leaves: its row in the summary, and its last step in the log."""
    store = _failed_run(w, "nightly")
    row = store.read("gold", "CustomerAnalyticsSummary").drop("TotalProcessingTimeMs")
    last = store.read("log", "ProcessLog").orderBy(F.desc("LogID")).limit(1)
    return row.join(last.select("RunID", "LogID", "StepName", "RowCount", "Message"), "RunID")


@query
def q_run_retried(w):
    """A run that failed and then succeeded under one id: one summary row, one log."""
    store = _failed_run(w, "nightly")
    run(store, w.source, replace(w.p, run_id="nightly"))
    log = store.read("log", "ProcessLog").groupBy("RunID").agg(F.count(F.lit(1)).alias("steps"), F.min("RowCount").alias("least_rows"))
    return store.read("gold", "CustomerAnalyticsSummary").drop("TotalProcessingTimeMs").join(log, "RunID", "full")


@query
def q_run_times(w):
    """Every step of a run in the order the log is shown in, whether its times are in order, and whether the summary's
    milliseconds are those between the start of the run and its last step, up to a minute."""
    store, p = w.run(FULL)
    shown = runlog.show(store).withColumn("place", F.monotonically_increasing_id())
    placed = shown.withColumn("place", F.row_number().over(Window.partitionBy("ProcessDate").orderBy("place")))  # eight rows
    taken = store.read("gold", "CustomerAnalyticsSummary").select(F.col("RunID").alias("of"), "TotalProcessingTimeMs")
    until = F.timestamp_diff("MILLISECOND", F.col("RunStarted"), F.max("EndTime").over(Window.partitionBy("RunID")))
    return placed.join(taken, F.col("RunID") == F.col("of")).select(
        "LogID", "place", "StepName", (F.timestamp_diff("MILLISECOND", "StartTime", "EndTime") >= 0).alias("ends_after_start"),
        (F.abs(until - F.col("TotalProcessingTimeMs")) < 60_000).alias("summary_agrees"),
    )


@query
def q_saved_table(w):
    """Analytics saved as a catalog table, twice: the second time replaces the first."""
    name, path = f"patronage_{uuid.uuid4().hex}", scratch_path(w.spark)
    rows = w.scored.select("CustomerID", "BehaviorSegment", "TargetGroup")
    for df in (rows.where("CustomerID % 2 = 0"), rows):
        w.store.save_table(df, name, path)
    return w.store.read_table(name)


@query
def q_run_report(w):
    """The report of a run in debug mode, read back from its file, without times."""
    store = TableStore(w.spark, scratch_path(w.spark))
    p = replace(w.p, debug_mode=True)
    run(store, w.source, p)
    report = w.spark.read.schema(REPORT_SCHEMA).json(store.path("log", f"report_{p.data_date}_{p.process_type}"))
    layer = report.select("process_date", "process_type", F.col("status").alias("run_status"), "error", F.explode("layers").alias("l"))
    return layer.select(
        "process_date", "process_type", "run_status", F.col("l.layer").alias("layer"), F.col("l.status").alias("layer_status"),
        F.array_join("l.tables", ",").alias("tables"), F.coalesce("error", F.lit("")).alias("error"),
    )


@query
def q_run_log(w):
    store, _ = w.run(FULL)
    return runlog.show(store).select("LogID", "StepName", "RowCount", "Message")


# Texts


@query
def q_last_response(w):
    return messages.last_response(w.source.raw("conversations"), "assistant")


@query
def q_response_fallback(w):
    return messages.response_fallback(w.source.raw("conversations"), FALLBACKS)


@query
def q_message_stats(w):
    return messages.message_stats(w.source.raw("conversations"))


@query
def q_text_snippet(w):
    return messages.text_snippets(w.source.raw("conversations"))


@query
def q_conversation_export(w):
    return messages.conversation_export(w.source.raw("conversations"))


@query
def q_from_references(w):
    return scripts.table_references(w.source.raw("documents"), "doc_id")


@query
def q_sql_inventory(w):
    found = scripts.sql_inventory(w.source.raw("documents"), "doc_id")
    lists = ("referenced_tables", "ctes")
    return found.withColumns({c: F.array_join(c, ",") for c in lists})


def _script(text, number):
    """A text as the comments and literals of a script that names tables in every way, some of them CTEs."""
    plain = F.regexp_replace(text, r"/\*|\*/", " ")
    parts = [
        "-- FROM remark ", F.regexp_replace(text, "\n", " "), "\n/* ", plain, " FROM hidden /* nested JOIN inner_one */ */\nWITH first_", number % 4,
        " AS (SELECT '", F.replace(text, F.lit("'"), F.lit("''")), "' AS note FROM [dbo].[Orders ", number % 5,
        "] WHERE d > '1'),\nsecond (a, b) AS (SELECT a, b FROM FIRST_", number % 4, ' JOIN "Raw FROM x" . t', number % 7,
        " ON 1 = 1)\nSELECT N'it''s FROM nowhere', [JOIN me] FROM second s LEFT JOIN schema", number % 3,
        ".customers c ON s.a = c.a WHERE EXTRACT(YEAR FROM c.d) = 2001 AND EXISTS (SELECT 1 FROM split_words('a FROM b') f)",
    ]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query
def q_sql_references_scanned(w):
    documents = w.source.raw("documents")
    scripts_ = documents.select("doc_id", _script(F.col("text"), F.col("doc_id")).alias("text"))
    found = scripts.scanned_references(scripts_, "doc_id")
    return found.withColumns({c: F.array_join(c, ",") for c in ("scanned_tables", "scanned_ctes")})


@query
def q_sql_references_in_prose(w):
    """What the scan finds in texts that were never written as scripts."""
    found = scripts.scanned_references(w.source.raw("documents"), "doc_id")
    return found.select(F.size("scanned_ctes").alias("ctes")).groupBy("ctes").agg(F.count(F.lit(1)).alias("documents"))


@query
def q_scripts_read(w):
    """Scripts of a hundred documents each, written as files and read back whole."""
    folder, part = scratch_path(w.spark), F.floor(F.col("doc_id") / 100).alias("part")
    rows = w.source.raw("documents").select("doc_id", "text", part).repartition("part").sortWithinPartitions("part", "doc_id")
    rows.select("part", "text").write.partitionBy("part").text(folder)
    read = scripts.read_scripts(w.spark, folder)
    number = F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint")
    return read.select(number.alias("part"), F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"))


def _fenced(text, number):
    """A text with fences, in one of four shapes by a number: one block of several lines; an empty block and one with
    another language's name; a fence that is never closed; each line as a block of its own with prose between."""
    between = "\n```\nthen\n ```python \n"
    shape = F.pmod(number, F.lit(4))
    return (
        F.when(shape == 0, F.concat(F.lit("intro\n```python\n"), text, F.lit("\n```\nend")))
        .when(shape == 1, F.concat(F.lit("```python\n```\nafter\n```pyspark\n"), text, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("never closed\n```python\n"), text))
        .otherwise(F.concat(F.lit("first\n```python\n"), F.regexp_replace(text, "\n", between), F.lit("\n```\nend")))
    )


def _fenced_messages(w: Workspace) -> DataFrame:
    return w.source.raw("conversations").withColumn("text", _fenced(F.col("text"), F.col("conv_id")))


@query
def q_code_blocks(w):
    fenced = w.source.raw("documents").withColumn("text", _fenced(F.col("text"), F.col("doc_id")))
    return messages.code_blocks(fenced, "doc_id")


@query
def q_code_text(w):
    """Fenced code of the documents in English, the plain text of all others."""
    text = F.when(F.col("lang") == "en", _fenced(F.col("text"), F.col("doc_id"))).otherwise(F.col("text"))
    return scripts.cleaned_code(w.source.raw("documents").withColumn("text", text), "doc_id")


@query
def q_stage_blocks(w):
    marker = F.lit("")
    for role, stage in ROLE_STAGES.items():
        marker = F.when(F.col("role") == role, dict(fx.STAGE_MARKERS)[stage]).otherwise(marker)
    blocks = w.source.raw("conversations").select(
        "conv_id", F.col("turn").alias("position"), F.concat(marker, F.lit("\n"), "text").alias("block")
    )
    return messages.stage_blocks(blocks)


@query
def q_artifacts(w):
    found = messages.artifacts(_fenced_messages(w), "assistant", "user", "system")
    return found.withColumns({c: F.array_join(c, "\n\n") for c in ("code_blocks", "test_blocks")})
