"""The three layers. Each table is written once and read back, so no later step repeats its work."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.contracts import SOURCES, conform, require
from patronage.functions import fixed_values as fx
from patronage.functions.columns import with_run_metadata
from patronage.operators.customers import customer_base
from patronage.operators.merge import require_unique
from patronage.operators.metrics import METRIC_COLUMNS
from patronage.operators.purchase_state import merged, purchase_state, summary_from_state
from patronage.operators.segments import (
    ANALYTICS_COLUMNS,
    SEGMENT_COLUMNS,
    customer_profile,
    scored_customers,
    summarize,
)
from patronage.operators.transactions import transaction_summary
from patronage.params import FULL, RunParams
from patronage.plans.runlog import RunLog, summary_row
from patronage.sources.durable import durable
from patronage.sources.store import TableStore

TABLES_AT_ONCE = 4
RUN_DATE = {"bronze": "_ingestion_date", "silver": "_silver_process_date", "gold": "_gold_process_date"}


class Source(Protocol):
    def table(self, name: str) -> DataFrame: ...


@dataclass
class Frames:
    """Any mapping of ready frames as a source."""

    frames: Mapping[str, DataFrame]

    def table(self, name: str) -> DataFrame:
        return require(self.frames, name)[0]


def write_slice(
    store: TableStore, df: DataFrame, layer: str, name: str, p: RunParams
) -> tuple[int, DataFrame]:
    """Writes the run date's partition of a layer table, metadata columns added; the rows and the slice."""
    stamped = with_run_metadata(df, layer, p.data_date, p.started_at)
    rows = store.replace_partitions(stamped, layer, name, {RUN_DATE[layer]: p.data_date}, evolve=True)
    if rows == 0:  # an empty partition leaves no folder to read
        return 0, store.spark.createDataFrame([], df.schema)
    return rows, read_slice(store, layer, name, p)


def read_slice(store: TableStore, layer: str, name: str, p: RunParams) -> DataFrame:
    """The run date's rows; only that date's folder is listed and read."""
    day = RUN_DATE[layer]
    rows = store.read_partition(layer, name, {day: p.data_date})
    return rows.drop(day, day.replace("_date", "_timestamp"))


def ingest_bronze(store: TableStore, source: Source, name: str, p: RunParams) -> tuple[int, DataFrame]:
    """One source table into the bronze layer, read once. A source may gain, lose and widen columns from one ingest to
    the next: the stored table follows, and earlier dates stay as they are."""
    return write_slice(store, conform(source.table(name), name, p.all_source_columns), "bronze", f"dbo.{name}", p)


def run_bronze(store: TableStore, source: Source, p: RunParams, log: RunLog) -> dict[str, DataFrame]:
    """All source tables, several at a time as they do not depend on each other. Any failure ends the run."""
    with log.step("Bronze Ingestion", "Ingested source tables") as step:
        with ThreadPoolExecutor(max_workers=TABLES_AT_ONCE) as pool:
            done = dict(zip(SOURCES, pool.map(lambda name: ingest_bronze(store, source, name, p), SOURCES)))
        step.rows = sum(rows for rows, _ in done.values())
    return {name: frame for name, (_, frame) in done.items()}


def run_silver(
    store: TableStore, bronze: Mapping[str, DataFrame], p: RunParams, log: RunLog
) -> dict[str, DataFrame]:
    customers, addresses, interactions, orders, details, products, returns = require(bronze, *SOURCES)
    with log.step(*fx.STEP_BASE) as step:
        require_unique(customers, SOURCES["Customers"].key)
        base = customer_base(customers, addresses, interactions, p)
        step.rows, base = write_slice(store, base, "silver", "CustomerBase", p)
    with log.step(*fx.STEP_SUMMARY) as step:
        require_unique(products, SOURCES["Products"].key)
        if p.keep_state:
            states = PurchaseStates(store)
            states.put(purchase_state(orders, details, returns), p)
            summary = summary_from_state(states.read(), base, products, p)
        else:
            summary = transaction_summary(base, orders, details, products, returns, p)
        step.rows, summary = write_slice(store, summary, "silver", "TransactionSummary", p)
    return {"CustomerBase": base, "TransactionSummary": summary}


class PurchaseStates:
    """The stored purchase states: that of a full run, and one of each slice since, by its date.

    A slice that is put again replaces itself, so a run may be repeated. ``compact`` adds slices to the full
    state; the new one counts, and the slices in it stop counting, with one commit. Slices older than ``state_days``
    are added as soon as there are as many of them; younger ones stay and can be delivered again.
    """

    LAYER, BASE, SLICES, DAY, THROUGH = "silver", "PurchaseState", "PurchaseStateSlices", "SliceDate", "ThroughDate"

    def __init__(self, store: TableStore):
        self.store = store

    def through(self) -> date | None:
        """The last day in the full state."""
        if not self.store.exists(self.LAYER, self.BASE):
            return None
        return self.store.read(self.LAYER, self.BASE).agg(F.max(self.THROUGH)).first()[0]

    def put(self, state: DataFrame, p: RunParams) -> None:
        """The state of a full run starts anew; that of an incremental one is its day's slice."""
        if p.process_type == FULL:
            self._start(state, p.data_date)
            return
        through = self.through()
        if through is not None and p.data_date <= through:
            raise ValueError(f"the slice of {p.data_date} is part of the full state already, which goes through {through}")
        self.store.replace_partitions(state, self.LAYER, self.SLICES, {self.DAY: p.data_date}, evolve=True)
        settled = p.data_date - timedelta(days=p.state_days)
        days = [d for d in self.days() if (through or date.min) < d <= settled]
        if len(days) >= p.state_days:  # many at once, as each time rewrites the full state
            self.compact(settled)

    def days(self) -> list[date]:
        """The days that have a slice of their own, in order."""
        prefix = f"{self.DAY}="
        names = self.store._children(self.store.path(self.LAYER, self.SLICES))
        return [date.fromisoformat(n[len(prefix) :]) for n in names if n.startswith(prefix)]

    def _start(self, state: DataFrame, through: date) -> None:
        self.store.overwrite(state.withColumn(self.THROUGH, F.lit(through)), self.LAYER, self.BASE)
        if self.store.exists(self.LAYER, self.SLICES):
            self.store.drop_before(self.LAYER, self.SLICES, self.DAY, through + timedelta(days=1))

    def read(self) -> DataFrame:
        """The state of everything put so far, not yet added up by customer and product."""
        parts, through = [], self.through()
        if self.store.exists(self.LAYER, self.BASE):
            parts.append(self.store.read(self.LAYER, self.BASE).drop(self.THROUGH))
        if self.store.exists(self.LAYER, self.SLICES):
            slices = self.store.read(self.LAYER, self.SLICES)
            parts.append(slices.where(F.col(self.DAY) > F.lit(through or date.min)).drop(self.DAY))
        if not parts:
            raise FileNotFoundError("no purchase state was stored; start with a full run")
        return reduce(lambda a, b: a.unionByName(b), parts)

    def compact(self, through: date) -> None:
        """Adds the slices up to a day to the full state."""
        if not self.store.exists(self.LAYER, self.SLICES):
            return
        slices, known = self.store.read(self.LAYER, self.SLICES), self.through()
        due = slices.where((F.col(self.DAY) <= F.lit(through)) & (F.col(self.DAY) > F.lit(known or date.min))).drop(self.DAY)
        parts = [due] if known is None else [self.store.read(self.LAYER, self.BASE).drop(self.THROUGH), due]
        self._start(merged(*parts), max(through, known or through))


def run_gold(
    store: TableStore, silver: Mapping[str, DataFrame], p: RunParams, log: RunLog
) -> dict[str, DataFrame]:
    """Metrics, segments, profiles, analytics, retention and the run summary.

    Every customer may occur once in the base. Everything but the profiles is then a projection of the
    stored summary, so the three tables of scored customers cost one narrow scan each and no join.
    """
    base, summary = require(silver, "CustomerBase", "TransactionSummary")
    with log.step(*fx.STEP_METRICS) as step:
        require_unique(base, "CustomerID")  # the summary is grouped by it, so profiles are unique too
        scored = scored_customers(summary, p)
        metrics = scored.select(*METRIC_COLUMNS)
        step.rows, metrics = write_slice(store, metrics, "gold", "CustomerMetrics", p)
    with log.step(*fx.STEP_SEGMENTS) as step:
        segments = scored.select(*SEGMENT_COLUMNS)
        step.rows, segments = write_slice(store, segments, "gold", "CustomerSegments", p)
    with log.step(*fx.STEP_PERSIST) as step:
        store.upsert(
            durable(customer_profile(base, summary)),  # a join, and an upsert reads its source twice
            "gold",
            "CustomerProfiles",
            "CustomerID",
            p.started_at,
            keep=("CreatedDate",),
            key_checked=True,
        )
        analytics = scored.withColumn("ProcessDate", F.lit(p.data_date)).select(*ANALYTICS_COLUMNS)
        stamped = with_run_metadata(analytics, "gold", p.data_date, p.started_at)
        step.rows = store.replace_partitions(stamped, "gold", "CustomerAnalytics", {"ProcessDate": p.data_date}, evolve=True)
        if not p.debug_mode:
            store.drop_before("gold", "CustomerAnalytics", "ProcessDate", p.retention_cutoff)
    with log.step(*fx.STEP_REPORT) as step:
        counts = summarize(scored, p).first().asDict()
        row = summary_row(store.spark, p, counts, log.elapsed_ms())
        step.rows = store.replace_run(row.coalesce(1), "gold", "CustomerAnalyticsSummary", log.run_id)
    return {
        "CustomerMetrics": metrics,
        "CustomerSegments": segments,
        "CustomerAnalytics": analytics,
        "CustomerAnalyticsSummary": row,
    }
