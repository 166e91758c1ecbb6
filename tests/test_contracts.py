from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from patronage.contracts import conform
from patronage.operators.transactions import net_amount


def test_digits_of_the_source_are_kept(spark):
    df = spark.sql("SELECT 1L OrderID, 2L ProductID, 1.0005BD Quantity, 9.9999BD UnitPrice, 0.125BD Discount, 'x' extra")
    kept = conform(df, "OrderDetails")
    assert kept.columns == ["OrderID", "ProductID", "Quantity", "UnitPrice", "Discount"]
    amount = kept.select(net_amount(kept).alias("n")).first().n
    assert amount == Decimal("1.0005") * Decimal("9.9999") * Decimal("0.875")


def test_binary_fractions_need_a_cast(spark):
    df = spark.sql("SELECT 1L OrderID, 2L ProductID, 1.5D Quantity, 9.5BD UnitPrice, 0BD Discount")
    with pytest.raises(ValueError, match="OrderDetails.Quantity is double"):
        conform(df, "OrderDetails")


def test_whole_numbers_become_decimals_and_broken_keys_raise(spark):
    df = spark.sql("SELECT 1 OrderID, 2.0BD ProductID, 3 Quantity, 4L UnitPrice, 0BD Discount")
    assert conform(df, "OrderDetails").first().Quantity == 3
    with pytest.raises(Exception, match="no whole number"):
        conform(df.withColumn("ProductID", F.lit(Decimal("2.5"))), "OrderDetails").collect()
