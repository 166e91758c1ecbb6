"""The seven source tables derived from an order star schema stored as Parquet.

customer, nation and region give Customers and CustomerAddresses; events give CustomerInteractions;
orders, lineitem and part give Orders, OrderDetails, Products and Returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.contracts import FRACTION, MONEY, SOURCES, conform

ORDER_STATUS = {"F": "Completed", "O": "Open", "P": "Pending"}


class StarSchema:
    """Reads ``<folder>/<table>.parquet`` and maps it to the source contract, table by table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        """A table as stored; listed and opened once, however many queries use it."""
        if table not in self._opened:
            self._opened[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._opened[table]

    def table(self, name: str) -> DataFrame:
        build = {
            "Customers": self._customers,
            "CustomerAddresses": self._addresses,
            "CustomerInteractions": self._interactions,
            "Orders": self._orders,
            "OrderDetails": self._details,
            "Products": self._products,
            "Returns": self._returns,
        }[name]
        return conform(build(), name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in SOURCES}

    def customer_ids(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("CustomerID"))

    def order_totals(self) -> DataFrame:
        """Orders with the total the order table itself carries."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("OrderID"),
            F.col("o_custkey").alias("CustomerID"),
            F.to_date("o_orderdate").alias("OrderDate"),
            F.col("o_totalprice").cast("decimal(15,2)").alias("OrderTotal"),
        )

    def _customers(self) -> DataFrame:
        span = (
            self.raw("orders")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(
                F.to_date(F.min("o_orderdate")).alias("CreatedDate"),
                F.to_date(F.max("o_orderdate")).alias("ModifiedDate"),
            )
        )
        return (
            self.raw("customer")
            .join(span, "c_custkey", "left")
            .select(
                F.col("c_custkey").alias("CustomerID"),
                F.split_part("c_name", F.lit("#"), F.lit(1)).alias("FirstName"),
                F.split_part("c_name", F.lit("#"), F.lit(2)).alias("LastName"),
                F.lit(None).cast("string").alias("Email"),
                F.lit(None).cast("string").alias("Phone"),
                F.col("c_mktsegment").alias("CustomerType"),
                F.col("c_nationkey").alias("AccountManagerID"),
                "CreatedDate",
                "ModifiedDate",
                F.when(F.col("c_acctbal") >= 0, "Active").otherwise("Inactive").alias("Status"),
            )
        )

    def _addresses(self) -> DataFrame:
        place = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        kind = F.when(F.col("c_custkey") % 10 == 0, "Billing").otherwise("Primary")
        nothing = F.lit(None).cast("string")
        return (
            self.raw("customer")
            .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("CustomerID"),
                kind.alias("AddressType"),
                nothing.alias("StreetAddress"),
                nothing.alias("PostalCode"),
                nothing.alias("City"),
                F.col("r_name").alias("State"),
                F.col("n_name").alias("Country"),
            )
        )

    def _interactions(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").alias("CustomerID"), F.to_date("ts").alias("ContactDate")
        )

    def _orders(self) -> DataFrame:
        # Nested with the completed code outermost: a test for that word folds into a test for its code.
        status = F.col("o_orderstatus")
        named = F.lit(None).cast("string")
        for code, word in reversed(ORDER_STATUS.items()):
            named = F.when(status == code, word).otherwise(named)
        return self.raw("orders").select(
            F.col("o_orderkey").alias("OrderID"),
            F.col("o_custkey").alias("CustomerID"),
            F.to_date("o_orderdate").alias("OrderDate"),
            named.alias("Status"),
        )

    def _details(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("OrderID"),
            F.col("l_partkey").alias("ProductID"),
            F.col("l_quantity").cast(MONEY).alias("Quantity"),
            F.col("l_discount").cast(FRACTION).alias("Discount"),
            F.col("l_extendedprice").cast(MONEY).alias("GrossAmount"),
        )

    def _products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("ProductID"),
            F.col("p_type").alias("Category"),
            F.col("p_name").alias("ProductName"),
        )

    def _returns(self) -> DataFrame:
        """First lines marked returned, of completed orders; an order counts as one return."""
        returned = self.raw("lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1))
        finished = self.raw("orders").where(F.col("o_orderstatus") == "F")
        return (
            finished.select("o_orderkey", "o_custkey")
            .join(returned.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
            .select(F.col("o_orderkey").alias("ReturnID"), F.col("o_custkey").alias("CustomerID"))
        )
