"""What the JDBC reader is asked for. No database is started; a recorder stands in for the session."""

import pytest

from patronage.sources.jdbc import JdbcSource, TableRead, key_predicates, read_jdbc, sql_server_url


class Recorder:
    def __init__(self, low=1, high=1000):
        self.calls, self.read, self.range = [], self, (low, high)

    def jdbc(self, url, table, **options):
        self.calls.append({"url": url, "table": table, **options})
        return self

    def first(self):
        return self.range


URL = sql_server_url("host", "shop")


def test_url():
    assert URL.startswith("jdbc:sqlserver://host;databaseName=shop;encrypt=true")


def test_plain_read_happens_once():
    spark = Recorder()
    read_jdbc(spark, URL, "dbo.Orders", {"user": "me", "queryTimeout": "9"})
    assert len(spark.calls) == 1
    assert spark.calls[0]["properties"] == {"fetchsize": "10000", "user": "me", "queryTimeout": "9"}


def test_split_read_asks_for_the_key_range():
    spark = Recorder(5, 77)
    read_jdbc(spark, URL, "dbo.Orders", column="OrderID", num_partitions=8)
    bounds, scan = spark.calls
    assert "MIN(OrderID)" in bounds["table"] and "FROM dbo.Orders" in bounds["table"]
    assert (scan["lowerBound"], scan["upperBound"], scan["numPartitions"], scan["column"]) == (5, 77, 8, "OrderID")


def test_given_bounds_and_predicates():
    spark = Recorder()
    read_jdbc(spark, URL, "t", column="k", num_partitions=4, bounds=(0, 9))
    read_jdbc(spark, URL, "t", predicates=["k < 5", "k >= 5"])
    assert [c.get("lowerBound") for c in spark.calls] == [0, None]
    assert spark.calls[1]["predicates"] == ["k < 5", "k >= 5"]


def test_empty_table_is_read_in_one_part():
    spark = Recorder(None, None)
    read_jdbc(spark, URL, "t", column="k", num_partitions=4)
    assert "numPartitions" not in spark.calls[-1]


@pytest.mark.parametrize("name,key", [("Customers", "CustomerID"), ("OrderDetails", "OrderID"), ("Returns", "ReturnID")])
def test_source_splits_every_table_on_its_key(name, key):
    spark = Recorder()
    JdbcSource(spark, URL, {"user": "u"}, num_partitions=6).table(name)
    assert spark.calls[-1]["table"] == f"dbo.{name}" and spark.calls[-1]["column"] == key
    assert spark.calls[-1]["numPartitions"] == 6


def test_tables_may_be_read_each_in_its_own_way():
    spark = Recorder()
    reads = {"Orders": TableRead(num_partitions=40, bounds=(1, 9)), "Returns": TableRead(predicates=("ReturnID < 5", "ReturnID >= 5"))}
    source = JdbcSource(spark, URL, num_partitions=6, reads=reads)
    for name in ("Orders", "Returns", "Products"):
        source.table(name)
    orders, returns, _, products = spark.calls
    assert (orders["numPartitions"], orders["lowerBound"]) == (40, 1) and products["numPartitions"] == 6
    assert returns["predicates"] == ["ReturnID < 5", "ReturnID >= 5"]
    with pytest.raises(ValueError, match="Order"):
        JdbcSource(spark, URL, reads={"Order": TableRead()})


def test_predicates_cover_every_row_once(spark):
    conditions = key_predicates("k", [10, 20], hot={7: ("m", 3), 15: ("m", 2)})
    rows = spark.range(200).selectExpr("if(id % 11 = 0, null, id % 30) AS k", "if(id % 13 = 0, null, id - 100) AS m")
    hits = rows.selectExpr("+".join(f"if({c}, 1, 0)" for c in conditions) + " AS n")
    assert hits.where("n <> 1").count() == 0
    assert key_predicates("k", []) == ("k IS NOT NULL", "k IS NULL")
