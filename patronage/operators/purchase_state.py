"""Purchases per customer as sums that add up, so that new orders never need the lines of old ones.

A state has one row per customer with the number and totals of the orders (kind ``orders``), one per customer and product
with those of the lines (``product``) and one with the number of returns (``returns``). States of slices that share no order and no return are
merged by adding, in any order and grouping. Categories and names are looked up when a summary is made from a state, so
a product that is renamed counts under its new name at once, as if all lines were read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.operators.transactions import favourite, line_facts, summary_columns
from patronage.params import RunParams

ORDERS, PRODUCT, RETURNS = "orders", "product", "returns"
KEYS = ("CustomerID", "Kind", "ProductID")
#: Decimal digits of sums, which no further addition changes.
DIGITS = 38


def _sum(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    wide = T.DecimalType(DIGITS, kind.scale) if isinstance(kind, T.DecimalType) else kind
    return F.sum(column).cast(wide).alias(column)


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(
        F.sum("Count").alias("Count"), _sum(rows, "Net"), _sum(rows, "Quantity"), F.min("First").alias("First"), F.max("Last").alias("Last")
    )


def purchase_state(orders: DataFrame, details: DataFrame, returns: DataFrame) -> DataFrame:
    """The state of completed orders and of returns. Lines are joined once and combined by order and by product before
    the customer, so that a customer with a large share of them is no single task's work."""
    facts = line_facts(orders, details)
    grains = facts.groupingSets([("CustomerID", "OrderID"), ("CustomerID", "ProductID")], "CustomerID", "OrderID", "ProductID").agg(
        F.grouping("OrderID").alias("ByProduct"),
        F.count(F.lit(1)).alias("Lines"),
        F.sum("NetAmount").alias("Net"),
        F.sum("Quantity").alias("Quantity"),
        F.min("OrderDate").alias("First"),
        F.max("OrderDate").alias("Last"),
    )
    by_product = F.col("ByProduct") == 1
    bought = grains.select(
        "CustomerID", F.when(by_product, PRODUCT).otherwise(ORDERS).alias("Kind"), F.when(by_product, F.col("ProductID")).alias("ProductID"),
        F.when(by_product, F.col("Lines")).otherwise(1).alias("Count"), "Net", "Quantity", "First", "Last",
    )
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in bought.schema}
    given_back = returns.select("CustomerID", "ReturnID").distinct().where("ReturnID is not null").select(
        "CustomerID", F.lit(RETURNS).alias("Kind"), none["ProductID"], F.lit(1).cast("long").alias("Count"),
        *[none[c] for c in ("Net", "Quantity", "First", "Last")],
    )
    return _added(bought.unionByName(given_back))


def merged(*states: DataFrame) -> DataFrame:
    """The state of all slices together."""
    return _added(reduce(DataFrame.unionByName, states))


def summary_from_state(state: DataFrame, members: DataFrame, products: DataFrame, p: RunParams) -> DataFrame:
    """The same rows as ``transactions.transaction_summary`` over all orders of the members."""
    state = state.join(members.select("CustomerID"), "CustomerID", "left_semi")
    listed = products.select("ProductID", "Category", "ProductName", F.lit(True).alias("Listed"))
    named = state.join(listed, "ProductID", "left").groupingSets(
        [("CustomerID", "Kind"), ("CustomerID", "Kind", "Listed", "Category"), ("CustomerID", "Kind", "Listed", "ProductName")],
        "CustomerID", "Kind", "Listed", "Category", "ProductName",
    ).agg(
        F.grouping("Category").alias("AnyCategory"), F.grouping("ProductName").alias("AnyName"), F.grouping("Listed").alias("All"),
        F.sum("Count").alias("Count"), F.sum("Net").alias("Net"), F.sum("Quantity").alias("Quantity"), F.min("First").alias("First"), F.max("Last").alias("Last"),
    )

    def at(kind: str, value: Column, everything: Column = F.col("All") == 1) -> Column:
        return F.when((F.col("Kind") == kind) & everything, value)

    def most(label: str, amount: str, marker: str) -> Column:
        return favourite(label, amount, (F.col("Kind") == PRODUCT) & (F.col("All") == 0) & (F.col(marker) == 0) & F.col("Listed"))

    totals = named.groupBy("CustomerID").agg(
        F.sum(at(ORDERS, F.col("Count"))).alias("TotalOrders"),
        F.sum(at(ORDERS, F.col("Net"))).alias("TotalSpent"),
        F.min(at(ORDERS, F.col("First"))).alias("FirstPurchaseDate"),
        F.max(at(ORDERS, F.col("Last"))).alias("LastPurchaseDate"),
        most("Category", "Net", "AnyCategory").alias("TopCategory"),
        most("ProductName", "Quantity", "AnyName").alias("TopProduct"),
        F.sum(at(RETURNS, F.col("Count"))).alias("TotalReturns"),
    )
    return summary_columns(totals.where("TotalOrders > 0"), p)
