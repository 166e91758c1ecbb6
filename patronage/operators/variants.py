"""Summaries at other grains: without a status filter, counted per line or straight from orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import ratio
from patronage.operators.metrics import SCORES, TILES
from patronage.operators.ntile import By, ntile_global


def _days_since(day: date, column: str):
    return F.datediff(F.lit(day), column)


def per_order(lines: DataFrame) -> DataFrame:
    """Lines summed by order: joined lines lie by OrderID already, so no line is shuffled for this."""
    return lines.groupBy("OrderID", "CustomerID", "OrderDate").agg(
        F.count("OrderID").alias("Lines"), F.count("NetAmount").alias("Amounts"), F.sum("NetAmount").alias("Net")
    )


def line_grain_summary(lines: DataFrame, day: date) -> DataFrame:
    """Per customer over all lines whatever the order's status; TotalOrders counts lines."""
    totals = per_order(lines).groupBy("CustomerID").agg(
        F.sum("Lines").alias("TotalOrders"),
        F.sum("Net").alias("TotalSpent"),
        F.min("OrderDate").alias("FirstPurchaseDate"),
        F.max("OrderDate").alias("LastPurchaseDate"),
    )
    return totals.withColumns(
        {
            "AvgOrderValue": ratio(F.col("TotalSpent"), F.col("TotalOrders").cast("decimal(12,0)")),
            "DaysSinceLastPurchase": _days_since(day, "LastPurchaseDate"),
        }
    )


def line_average_summary(lines: DataFrame, day: date) -> DataFrame:
    """As ``line_grain_summary``, with the average taken over lines inside the aggregation."""
    return per_order(lines).groupBy("CustomerID").agg(
        F.sum("Lines").alias("TotalOrders"),
        F.sum("Net").alias("TotalSpent"),
        (F.sum("Net") / F.sum("Amounts").cast("decimal(12,0)")).alias("AvgOrderValue"),
        F.min("OrderDate").alias("FirstPurchaseDate"),
        F.max("OrderDate").alias("LastPurchaseDate"),
        _days_since(day, F.max("OrderDate")).alias("DaysSinceLastPurchase"),
    )


def rfm_inputs(orders: DataFrame, amount: str, day: date) -> DataFrame:
    """Frequency, monetary value and recency straight from an order table."""
    return orders.groupBy("CustomerID").agg(
        F.count("OrderID").alias("Frequency"),
        F.sum(amount).alias("Monetary"),
        _days_since(day, F.max("OrderDate")).alias("Recency"),
    )


def rfm_from_orders(inputs: DataFrame) -> DataFrame:
    """Scores the ``rfm_inputs``; the input is read twice, so store it first."""
    rankings = {
        "RecencyScore": F.col("Recency"),
        "FrequencyScore": By(F.col("Frequency"), descending=True),
        "MonetaryScore": By(F.col("Monetary"), descending=True),
    }
    return ntile_global(inputs, rankings, TILES, "CustomerID")


def rfm_line_grain(summary: DataFrame) -> DataFrame:
    """Scores a ``line_grain_summary``; the input is read twice, so store it first."""
    rankings = {
        "RecencyScore": F.col("DaysSinceLastPurchase"),
        "FrequencyScore": By(F.col("TotalOrders"), descending=True),
        "MonetaryScore": By(F.col("TotalSpent"), descending=True),
    }
    scored = ntile_global(summary, rankings, TILES, "CustomerID")
    return scored.withColumn("RFMScore", sum((F.col(name) for name in SCORES[1:]), F.col(SCORES[0])))
