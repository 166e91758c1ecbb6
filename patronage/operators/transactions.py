"""Order facts per customer: totals, favourite category and product, return rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions import fixed_values as fx
from patronage.functions.columns import ratio
from patronage.params import INCREMENTAL, RunParams

SUMMARY_COLUMNS = (
    "CustomerID",
    "TotalOrders",
    "TotalSpent",
    "AvgOrderValue",
    "FirstPurchaseDate",
    "LastPurchaseDate",
    "DaysSinceLastPurchase",
    "TopCategory",
    "TopProduct",
    "ReturnRate",
)


def net_amount(details: DataFrame) -> Column:
    """Line total after discount. A gross amount that the source already holds is used as it is."""
    known = [c for c in (("GrossAmount",), ("Quantity", "UnitPrice")) if set(c) <= set(details.columns)]
    gross = F.coalesce(*[F.col(c[0]) if len(c) == 1 else F.col(c[0]) * F.col(c[1]) for c in known])
    return gross * (F.lit(1) - F.col("Discount"))


def order_lines(orders: DataFrame, details: DataFrame) -> DataFrame:
    """Every line with its order's customer and date; narrowed before the shuffle on OrderID.

    Both sides reach the join straight from their scan, so adaptive execution can split an order that
    holds a large share of the lines.
    """
    lines = details.select("OrderID", "ProductID", "Quantity", net_amount(details).alias("NetAmount"))
    return orders.select("OrderID", "CustomerID", "OrderDate").join(lines, "OrderID")


def line_facts(orders: DataFrame, details: DataFrame) -> DataFrame:
    """Lines of completed orders."""
    return order_lines(orders.where(F.col("Status") == fx.COMPLETED_STATUS), details)


def order_summary(orders: DataFrame, details: DataFrame) -> DataFrame:
    """Completed orders, spend and first and last date per customer.

    Lines are summed per order before they meet the orders, so neither the shuffle nor the join sees an
    order's lines one by one. Orders are then counted by (customer, order) first and by customer second.
    """
    completed = orders.where(F.col("Status") == fx.COMPLETED_STATUS).select("OrderID", "CustomerID", "OrderDate")
    values = details.groupBy("OrderID").agg(F.sum(net_amount(details)).alias("OrderValue"))
    return (
        completed.join(values, "OrderID")
        .groupBy("CustomerID")
        .agg(
            F.countDistinct("OrderID").alias("TotalOrders"),
            F.sum("OrderValue").alias("TotalSpent"),
            F.min("OrderDate").alias("FirstPurchaseDate"),
            F.max("OrderDate").alias("LastPurchaseDate"),
        )
    )


def category_spend(facts: DataFrame, products: DataFrame) -> DataFrame:
    return (
        facts.select("CustomerID", "ProductID", "NetAmount")
        .join(products.select("ProductID", "Category"), "ProductID")
        .groupBy("CustomerID", "Category")
        .agg(F.sum("NetAmount").alias("CategorySpend"))
    )


def product_quantity(facts: DataFrame, products: DataFrame) -> DataFrame:
    return (
        facts.select("CustomerID", "ProductID", "Quantity")
        .join(products.select("ProductID", "ProductName"), "ProductID")
        .groupBy("CustomerID", "ProductName")
        .agg(F.sum("Quantity").alias("TotalQuantity"))
    )


def top_category(facts: DataFrame, products: DataFrame) -> DataFrame:
    """Category with the highest spend per customer; the first by name on a tie."""
    best_first = Window.partitionBy("CustomerID").orderBy(F.desc("CategorySpend"), F.asc("Category"))
    return _first_of(category_spend(facts, products), best_first)


def top_product(facts: DataFrame, products: DataFrame) -> DataFrame:
    """Product name with the highest quantity per customer; the first by name on a tie."""
    best_first = Window.partitionBy("CustomerID").orderBy(F.desc("TotalQuantity"), F.asc("ProductName"))
    return _first_of(product_quantity(facts, products), best_first)


def _first_of(df: DataFrame, window) -> DataFrame:
    """Rank = 1 is pushed below the shuffle as a group limit, so a task sends one row per customer."""
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") == 1).drop("rank")


def return_counts(returns: DataFrame) -> DataFrame:
    return returns.groupBy("CustomerID").agg(F.countDistinct("ReturnID").alias("TotalReturns"))


def return_percentage(returned: Column, orders: Column) -> Column:
    return ratio(returned.cast("decimal(12,0)"), orders.cast("decimal(12,0)")) * 100


def return_rate(returns: DataFrame, summary: DataFrame, p: RunParams) -> DataFrame:
    """Returns and return rate of the customers that have both returns and completed orders."""
    return (
        return_counts(returns)
        .join(summary.select("CustomerID", "TotalOrders"), "CustomerID")
        .withColumn(
            "ReturnRate",
            return_percentage(F.col("TotalReturns"), F.col("TotalOrders")).cast(p.rate_type),
        )
    )


def favourite(label: str, amount: str, counts: Column) -> Column:
    """Aggregate: the label of the largest amount among the rows that count, the first label on a tie, unknown amounts last."""
    best_first = F.struct(F.col(amount).isNull().alias("unknown"), (-F.col(amount)).alias("rank"), F.col(label))
    return F.min_by(label, F.when(counts, best_first))


# grouping_id of (CustomerID, OrderID, Listed, Category, ProductName): a set bit marks a column left out.
BY_ORDER, BY_CATEGORY, BY_PRODUCT = 0b00111, 0b01001, 0b01010


def purchase_totals(facts: DataFrame, products: DataFrame) -> DataFrame:
    """Order totals, favourite category and favourite product from one pass over the lines.

    The lines are joined once and aggregated at three grains by grouping sets; a second, much smaller
    aggregation folds the grains into the customer. Both combine on the map side and the first groups
    by more than the customer, so a customer with a large share of the lines is spread over all tasks.
    Lines whose product is not listed count for the order totals only. ProductID must be unique in
    ``products``.
    """
    listed = products.select("ProductID", "Category", "ProductName", F.lit(True).alias("Listed"))
    grains = (
        facts.join(listed, "ProductID", "left")
        .groupingSets(
            [
                ("CustomerID", "OrderID"),
                ("CustomerID", "Listed", "Category"),
                ("CustomerID", "Listed", "ProductName"),
            ],
            "CustomerID",
            "OrderID",
            "Listed",
            "Category",
            "ProductName",
        )
        .agg(
            F.grouping_id().alias("Grain"),
            F.sum("NetAmount").alias("Net"),
            F.sum("Quantity").alias("Quantity"),
            F.min("OrderDate").alias("First"),
            F.max("OrderDate").alias("Last"),
        )
    )

    def at(grain: int, value: Column) -> Column:
        return F.when(F.col("Grain") == grain, value)

    def most(grain: int, label: str, amount: str) -> Column:
        return favourite(label, amount, (F.col("Grain") == grain) & F.col("Listed"))

    return grains.groupBy("CustomerID").agg(
        F.count(at(BY_ORDER, F.lit(1))).alias("TotalOrders"),
        F.sum(at(BY_ORDER, F.col("Net"))).alias("TotalSpent"),
        F.min(at(BY_ORDER, F.col("First"))).alias("FirstPurchaseDate"),
        F.max(at(BY_ORDER, F.col("Last"))).alias("LastPurchaseDate"),
        most(BY_CATEGORY, "Category", "Net").alias("TopCategory"),
        most(BY_PRODUCT, "ProductName", "Quantity").alias("TopProduct"),
    )


def transaction_summary(
    members: DataFrame,
    orders: DataFrame,
    details: DataFrame,
    products: DataFrame,
    returns: DataFrame,
    p: RunParams,
) -> DataFrame:
    """One row per member with completed orders; ``members`` is the customer base, or its CustomerIDs.

    Restricting to the members gives the same rows before or after the totals. A full run has nearly every
    customer among them and restricts the small result; an incremental run has few and restricts the
    orders and returns first, so the rest of the lines is never aggregated.
    """
    members = members.select("CustomerID")
    if p.process_type == INCREMENTAL:
        orders = orders.join(members, "CustomerID", "left_semi")
        returns = returns.join(members, "CustomerID", "left_semi")
    totals = purchase_totals(line_facts(orders, details), products)
    if p.process_type != INCREMENTAL:
        totals = totals.join(members, "CustomerID", "left_semi")
    return summary_columns(totals.join(return_counts(returns), "CustomerID", "left"), p)


def summary_columns(totals: DataFrame, p: RunParams) -> DataFrame:
    """The summary's columns from a customer's totals."""
    spent, count = F.col("TotalSpent"), F.col("TotalOrders")
    percentage = return_percentage(F.coalesce("TotalReturns", F.lit(0)), count)
    return totals.select(
        "CustomerID",
        "TotalOrders",
        spent.cast(p.money_type).alias("TotalSpent"),
        ratio(spent, count.cast("decimal(12,0)")).cast(p.money_type).alias("AvgOrderValue"),
        "FirstPurchaseDate",
        "LastPurchaseDate",
        F.datediff(F.lit(p.data_date), "LastPurchaseDate").alias("DaysSinceLastPurchase"),
        "TopCategory",
        "TopProduct",
        percentage.cast(p.rate_type).alias("ReturnRate"),
    )
