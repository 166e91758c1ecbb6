"""Segments, target groups and recommendations, and the tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions import fixed_values as fx
from patronage.functions import rules
from patronage.functions.columns import first_match
from patronage.operators.customers import BASE_COLUMNS
from patronage.operators.metrics import METRIC_COLUMNS, with_metrics, with_rfm
from patronage.operators.transactions import SUMMARY_COLUMNS
from patronage.params import RunParams

SEGMENT_COLUMNS = (
    "CustomerID",
    "ValueSegment",
    "BehaviorSegment",
    "LifecycleSegment",
    "TargetGroup",
    "MarketingRecommendation",
)
AVERAGE_TYPE = T.DecimalType(28, 6)
ANALYTICS_COLUMNS = ("ProcessDate", *METRIC_COLUMNS, *SEGMENT_COLUMNS[1:])


def with_segments(measured: DataFrame, p: RunParams) -> DataFrame:
    """Adds the five segment columns to rows that hold both summary and metrics."""
    return measured.withColumns(
        {
            "ValueSegment": rules.value_segment(p),
            "BehaviorSegment": rules.behavior_segment(),
            "LifecycleSegment": rules.lifecycle_segment(),
            "TargetGroup": rules.target_group(p),
            "MarketingRecommendation": rules.recommendation(p),
        }
    )


def customer_segments(base: DataFrame, metrics: DataFrame, summary: DataFrame, p: RunParams) -> DataFrame:
    """Segments from separately stored tables; the base only says which customers belong."""
    measured = summary.join(metrics, "CustomerID")
    return with_segments(measured, p).select(*SEGMENT_COLUMNS).transform(_members_of, base)


def _members_of(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of customers in the base, each once however often the base names the customer."""
    return rows.join(base.select("CustomerID"), "CustomerID", "left_semi")


def scored_customers(summary: DataFrame, p: RunParams) -> DataFrame:
    """Summary, metrics and segments of every customer in one projection over the summary: no join."""
    return with_segments(with_metrics(with_rfm(summary, p), p), p)


def customer_analytics(metrics: DataFrame, segments: DataFrame, p: RunParams) -> DataFrame:
    return (
        metrics.join(segments, "CustomerID")
        .withColumn("ProcessDate", F.lit(p.data_date))
        .select(*ANALYTICS_COLUMNS)
    )


def customer_profile(base: DataFrame, summary: DataFrame) -> DataFrame:
    """Base customers with their summary; customers without completed orders have nulls."""
    kept = [c for c in BASE_COLUMNS if c != "ModifiedDate"]
    return base.select(*kept).join(summary.select(*SUMMARY_COLUMNS), "CustomerID", "left")


def analytics_summary(base: DataFrame, metrics: DataFrame, segments: DataFrame, p: RunParams) -> DataFrame:
    """Counts and average lifetime value of one run, in a single aggregation."""
    figures = metrics.select("CustomerID", "CustomerLifetimeValue").transform(_members_of, base)
    stages = segments.select("CustomerID", "ValueSegment", "LifecycleSegment")
    return summarize(stages.join(figures, "CustomerID"), p)


def summarize(rows: DataFrame, p: RunParams) -> DataFrame:
    """One row of counts; ``rows`` has every customer once, as the run makes sure of."""
    new, active, at_risk, churned, _ = fx.LIFECYCLE_SEGMENTS
    stage = F.col("LifecycleSegment")
    return rows.agg(
        F.count("CustomerID").alias("TotalCustomers"),
        F.count_if(stage == active).alias("ActiveCustomers"),
        F.count_if(stage == new).alias("NewCustomers"),
        F.count_if(stage.isin(at_risk, churned)).alias("ChurningCustomers"),
        F.count_if(F.col("ValueSegment") == fx.VALUE_SEGMENTS[0]).alias("HighValueCustomers"),
        F.coalesce(F.avg("CustomerLifetimeValue").cast(AVERAGE_TYPE), F.lit(0).cast(AVERAGE_TYPE)).alias(
            "AverageLifetimeValue"
        ),
    ).select(F.lit(p.data_date).alias("ProcessDate"), F.lit(p.process_type).alias("ProcessType"), "*")


def customer_wide(base: DataFrame, summary: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every customer with order totals and RFM score where known."""
    return (
        base.select("CustomerID", "CustomerName", "Email")
        .join(summary.select("CustomerID", "TotalOrders", "TotalSpent"), "CustomerID", "left")
        .join(metrics.select("CustomerID", "RFMScore"), "CustomerID", "left")
    )


def rfm_wide(metrics: DataFrame, summary: DataFrame) -> DataFrame:
    """Scores beside the figures they come from."""
    figures = summary.select(*[c for c in SUMMARY_COLUMNS if c not in ("TopCategory", "TopProduct", "ReturnRate")])
    scores = metrics.select("CustomerID", "RecencyScore", "FrequencyScore", "MonetaryScore", "RFMScore")
    return scores.join(figures, "CustomerID")


def simple_segments(summary: DataFrame, base: DataFrame, rule_set: str) -> DataFrame:
    """The simplified rule sets: "a" and "b" differ in lifecycle only."""
    spent, orders, days = (F.col(c) for c in ("TotalSpent", "TotalOrders", "DaysSinceLastPurchase"))
    top, middle = [F.lit(x).cast("decimal(15,2)") for x in fx.SIMPLE_SPEND_LIMITS]
    many, several = fx.SIMPLE_ORDER_LIMITS
    recent, current = fx.SIMPLE_DAY_LIMITS
    high, medium, low = fx.VALUE_SEGMENTS
    new, active, *_, inactive = fx.LIFECYCLE_SEGMENTS
    champions, loyal, *_, others = fx.BEHAVIOR_SEGMENTS
    lifecycle = {
        "a": [(days <= recent, F.lit(new)), (days <= current, F.lit(active))],
        "b": [(orders == 1, F.lit(new)), (days <= recent, F.lit(active))],
    }[rule_set]
    return summary.transform(_members_of, base).select(
        "CustomerID",
        first_match([(spent >= top, F.lit(high)), (spent >= middle, F.lit(medium))], low).alias("ValueSegment"),
        first_match([(orders >= many, F.lit(champions)), (orders >= several, F.lit(loyal))], others).alias(
            "BehaviorSegment"
        ),
        first_match(lifecycle, inactive).alias("LifecycleSegment"),
    )


def two_way_segments(scored: DataFrame) -> DataFrame:
    """High or low value by spend, champions or others by score."""
    top = F.lit(fx.SIMPLE_SPEND_LIMITS[0]).cast("decimal(15,2)")
    high, _, low = fx.VALUE_SEGMENTS
    return scored.select(
        "CustomerID",
        F.when(F.col("TotalSpent") >= top, high).otherwise(low).alias("ValueSegment"),
        F.when(F.col("RFMScore") >= fx.CHAMPION_SCORE, fx.BEHAVIOR_SEGMENTS[0])
        .otherwise(fx.BEHAVIOR_SEGMENTS[-1])
        .alias("BehaviorSegment"),
    )
