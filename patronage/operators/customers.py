"""Customer base: one row per customer with primary address and last contact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions import fixed_values as fx
from patronage.params import INCREMENTAL, RunParams

ADDRESS_FIELDS = ("StreetAddress", "PostalCode", "City", "State", "Country")
BASE_COLUMNS = (
    "CustomerID",
    "CustomerName",
    "Email",
    "Phone",
    "Address",
    "PostalCode",
    "City",
    "State",
    "Country",
    "CustomerType",
    "AccountManager",
    "CreatedDate",
    "ModifiedDate",
    "IsActive",
    "LastContactDate",
)


def last_contact(interactions: DataFrame) -> DataFrame:
    """Latest contact per customer; combines map-side, so a busy customer costs one row per task."""
    return interactions.groupBy("CustomerID").agg(F.max("ContactDate").alias("LastContactDate"))


def last_contact_by_window(interactions: DataFrame) -> DataFrame:
    """The same result in window form; prefer ``last_contact``.

    Repeated days collapse first, so a busy customer's window holds one row per day.
    """
    per_customer = Window.partitionBy("CustomerID")
    days = interactions.select("CustomerID", "ContactDate").distinct()
    return days.select("CustomerID", F.max("ContactDate").over(per_customer).alias("LastContactDate")).distinct()


def primary_addresses(addresses: DataFrame, on_duplicate: str = "keep") -> DataFrame:
    """Primary addresses. Equal copies collapse; different ones follow ``on_duplicate``."""
    primary = addresses.where(F.col("AddressType") == fx.PRIMARY_ADDRESS).select("CustomerID", *ADDRESS_FIELDS)
    if on_duplicate == "keep":
        return primary.distinct()
    whole = F.struct(*ADDRESS_FIELDS)
    chosen = primary.groupBy("CustomerID").agg(F.min(whole).alias("low"), F.max(whole).alias("high"))
    if on_duplicate == "error":
        message = F.concat(F.lit("several primary addresses for customer "), F.col("CustomerID").cast("string"))
        chosen = chosen.withColumn(
            "low", F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise(F.raise_error(message))
        )
    return chosen.select("CustomerID", "low.*")


def customer_name(null_safe: bool) -> Column:
    parts = (F.col("FirstName"), F.col("LastName"))
    return F.concat_ws(" ", *parts) if null_safe else F.concat(parts[0], F.lit(" "), parts[1])


def customer_base(customers: DataFrame, addresses: DataFrame, interactions: DataFrame, p: RunParams) -> DataFrame:
    """Customers with primary address and last contact, all of them or those changed since the run date.

    Addresses and contacts are reduced to the customer before joining, so the joins cannot fan out on a
    busy customer. Testing the latest contact is enough for INCREMENTAL: it is on or after the run date
    exactly when some contact is.
    """
    joined = customers.join(primary_addresses(addresses, p.on_duplicate_address), "CustomerID", "left").join(
        last_contact(interactions), "CustomerID", "left"
    )
    if p.process_type == INCREMENTAL:
        since = F.lit(p.data_date)
        joined = joined.where((F.col("ModifiedDate") >= since) | (F.col("LastContactDate") >= since))
    return joined.select(
        "CustomerID",
        customer_name(p.null_safe_name).alias("CustomerName"),
        "Email",
        "Phone",
        F.col("StreetAddress").alias("Address"),
        *ADDRESS_FIELDS[1:],
        "CustomerType",
        F.col("AccountManagerID").alias("AccountManager"),
        "CreatedDate",
        "ModifiedDate",
        F.when(F.col("Status") == fx.ACTIVE_STATUS, 1).otherwise(0).alias("IsActive"),
        "LastContactDate",
    )


def customer_base_sql(
    customers: DataFrame, addresses: DataFrame, interactions: DataFrame, p: RunParams
) -> DataFrame:
    """``customer_base`` as SQL text over the given frames; addresses are chosen as there."""
    spark = customers.sparkSession
    whole = f"struct({', '.join(ADDRESS_FIELDS)})"
    home = {
        "keep": "SELECT DISTINCT CustomerID, {whole} AS place FROM {{addresses}} WHERE AddressType = :primary",
        "first": "SELECT CustomerID, min({whole}) AS place FROM {{addresses}} WHERE AddressType = :primary GROUP BY CustomerID",
        "error": """SELECT CustomerID, if(min({whole}) <=> max({whole}), min({whole}), raise_error(
                concat('several primary addresses for customer ', CustomerID))) AS place
            FROM {{addresses}} WHERE AddressType = :primary GROUP BY CustomerID""",
    }[p.on_duplicate_address].replace("{whole}", whole).replace("{{", "{").replace("}}", "}")
    keep = "true"
    if p.process_type == INCREMENTAL:
        keep = "ModifiedDate >= :since OR LastContactDate >= :since"
    name = "concat_ws(' ', FirstName, LastName)" if p.null_safe_name else "FirstName || ' ' || LastName"
    return spark.sql(
        f"""
        WITH contact AS (
            SELECT CustomerID, max(ContactDate) AS LastContactDate FROM {{interactions}} GROUP BY CustomerID
        ), home AS (
            {home}
        )
        SELECT CustomerID, {name} AS CustomerName, Email, Phone, place.StreetAddress AS Address, place.PostalCode,
               place.City, place.State, place.Country,
               CustomerType, AccountManagerID AS AccountManager, CreatedDate, ModifiedDate,
               if(Status <=> :active, 1, 0) AS IsActive, LastContactDate
        FROM {{customers}} LEFT JOIN home USING (CustomerID) LEFT JOIN contact USING (CustomerID)
        WHERE {keep}
        """,
        args={"primary": fx.PRIMARY_ADDRESS, "active": fx.ACTIVE_STATUS, "since": p.data_date},
        customers=customers,
        addresses=addresses,
        interactions=interactions,
    )


def customer_lookup(base: DataFrame, customer_id: int) -> DataFrame:
    """One customer; the equality reaches the scan."""
    return base.where(F.col("CustomerID") == customer_id)


def customer_order_stats(customers: DataFrame, orders: DataFrame, order_total: str) -> DataFrame:
    """Order count and spend of every customer, also those without orders."""
    per_customer = orders.groupBy("CustomerID").agg(
        F.count("OrderID").alias("OrderCount"), F.sum(order_total).alias("TotalSpend")
    )
    return customers.join(per_customer, "CustomerID", "left").select(
        "CustomerID",
        F.concat_ws(" ", "FirstName", "LastName").alias("CustomerName"),
        F.coalesce("OrderCount", F.lit(0)).alias("OrderCount"),
        "TotalSpend",
    )
