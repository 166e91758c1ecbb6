"""Columns that come, go and widen between writes."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.contracts import conform
from patronage.operators.transactions import net_amount
from patronage.sources import evolution

DAYS = [date(2024, 1, d) for d in range(1, 6)]


def kind(ddl):
    return T._parse_datatype_string(ddl)


@pytest.mark.parametrize(
    ("a", "b", "both"),
    [
        ("int", "bigint", "bigint"), ("smallint", "tinyint", "smallint"), ("int", "decimal(6,2)", "decimal(12,2)"), ("decimal(15,2)", "decimal(10,4)", "decimal(17,4)"),
        ("bigint", "decimal(4,3)", "decimal(22,3)"), ("float", "double", "double"), ("int", "float", "double"), ("date", "timestamp_ntz", "timestamp_ntz"),
        ("array<int>", "array<bigint>", "array<bigint>"), ("map<string,int>", "map<string,bigint>", "map<string,bigint>"),
        ("struct<a:int,b:string>", "struct<a:bigint,c:date>", "struct<a:bigint,b:string,c:date>"), ("void", "string", "string"), ("string", "void", "string"),
    ],
)
def test_wider_types(spark, a, b, both):
    assert evolution.wider(kind(a), kind(b), "c").simpleString() == both
    if "struct" not in a:
        assert evolution.wider(kind(b), kind(a), "c").simpleString() == both


@pytest.mark.parametrize(("a", "b"), [("string", "int"), ("bigint", "double"), ("decimal(38,0)", "decimal(38,10)"), ("date", "timestamp"), ("array<int>", "int"), ("boolean", "int")])
def test_types_without_a_common_one(spark, a, b):
    with pytest.raises(ValueError, match="columns differ from the stored table: c is"):
        evolution.wider(kind(a), kind(b), "c")


def test_partitions_keep_the_schema_they_were_written_with(spark, store):
    put = lambda df, day: store.replace_partitions(df, "b", "t", {"day": day}, evolve=True)
    put(spark.createDataFrame([(1, "x", 5)], "id int, old string, n int"), DAYS[0])
    path = store.path("b", "t")
    files = store._children(f"{path}/day={DAYS[0]}")
    put(spark.createDataFrame([(2, 7_000_000_000, 1.5)], "id int, n bigint, new double"), DAYS[1])
    put(spark.createDataFrame([("4.25", (1, [2]))], "n string, s struct<a:int,b:array<int>>").withColumn("n", F.col("n").cast("decimal(5,2)")), DAYS[2])
    put(spark.createDataFrame([((1 << 40, [1 << 40], "c"),)], "s struct<a:bigint,b:array<bigint>,c:string>"), DAYS[3])
    assert store._children(f"{path}/day={DAYS[0]}") == files  # nothing is rewritten
    table = store.read("b", "t")
    assert table.drop("day").schema.simpleString() == "struct<id:int,old:string,n:decimal(21,2),new:double,s:struct<a:bigint,b:array<bigint>,c:string>>"
    got = {r.day: r for r in table.collect()}
    assert (got[DAYS[0]].id, got[DAYS[0]].old, int(got[DAYS[0]].n), got[DAYS[0]].new, got[DAYS[0]].s) == (1, "x", 5, None, None)
    assert (int(got[DAYS[1]].n), got[DAYS[1]].new, got[DAYS[1]].old) == (7_000_000_000, 1.5, None)
    assert (str(got[DAYS[2]].n), got[DAYS[2]].s.asDict(recursive=True)) == ("4.25", {"a": 1, "b": [2], "c": None})
    assert got[DAYS[3]].s.b == [1 << 40] and got[DAYS[3]].id is None
    for day in DAYS[:4]:
        (only,) = store.read_partition("b", "t", {"day": day}).collect()
        assert only.asDict() == got[day].asDict()
    # filters still reach the partitions and the files
    plan = store.read("b", "t", (F.col("day") == F.lit(DAYS[1])) & (F.col("id") == 2))
    assert [r.id for r in plan.collect()] == [2]
    assert "PartitionFilters: [isnotnull(day" in plan._jdf.queryExecution().executedPlan().toString()


def test_a_rewritten_partition_has_the_current_schema(spark, store):
    put = lambda df, day: store.replace_partitions(df, "b", "t", {"day": day}, evolve=True)
    put(spark.createDataFrame([(1,)], "id int"), DAYS[0])
    put(spark.createDataFrame([(1 << 40, "x")], "id bigint, c string"), DAYS[1])
    put(spark.createDataFrame([(1 << 41,)], "id bigint"), DAYS[0])
    assert store._older(store.path("b", "t")).all() == set()
    assert sorted((r.id, r.c) for r in store.read("b", "t").collect()) == [(1 << 40, "x"), (1 << 41, None)]
    assert put(spark.createDataFrame([], "id bigint, z string"), DAYS[0]) == 0
    assert [(r.id, r.c, r.z) for r in store.read("b", "t").collect()] == [(1 << 40, "x", None)]


def test_what_fails_leaves_the_table_as_it_was(spark, store):
    put = lambda df, day, evolve=True: store.replace_partitions(df, "b", "t", {"day": day}, evolve=evolve)
    put(spark.createDataFrame([(1, "a")], "id int, c string"), DAYS[0])
    with pytest.raises(ValueError, match="c is int, was string"):
        put(spark.createDataFrame([(1, 2)], "id int, c int"), DAYS[1])
    with pytest.raises(ValueError, match="columns differ from the stored table: d"):
        put(spark.createDataFrame([(1, "b", 2)], "id int, c string, d int"), DAYS[1], evolve=False)
    bad = spark.createDataFrame([(1, "b", 2)], "id bigint, c string, d int").withColumn("d", F.raise_error(F.lit("boom")).cast("int"))
    for day in DAYS[:2]:
        with pytest.raises(Exception, match="boom"):
            put(bad, day)
    assert [(r.id, r.c, r.d, r.day) for r in store.read("b", "t").collect()] == [(1, "a", None, DAYS[0])]


def test_retention_and_partitions_of_several_columns(spark, store):
    put = lambda df, day, part: store.replace_partitions(df, "b", "t", {"day": day, "part": part}, evolve=True)
    for day in DAYS[:3]:
        put(spark.createDataFrame([(1,)], "id int"), day, "a/b")
    put(spark.createDataFrame([(2, 3)], "id int, n int"), DAYS[3], "c")
    assert store._older(store.path("b", "t")).all() == {f"day={d}/part=a%2Fb" for d in DAYS[:3]}
    store.drop_before("b", "t", "day", DAYS[2])
    assert store._older(store.path("b", "t")).all() == {f"day={DAYS[2]}/part=a%2Fb"}
    assert sorted((r.id, r.n, r.day, r.part) for r in store.read("b", "t").collect()) == [(1, None, DAYS[2], "a/b"), (2, 3, DAYS[3], "c")]


def test_line_totals_when_the_source_changed(spark):
    lines = spark.sql("select cast(2 as decimal(15,2)) Quantity, cast(3 as decimal(15,2)) UnitPrice, cast(null as decimal(15,2)) GrossAmount, cast(0 as decimal(4,2)) Discount")
    assert [int(r[0]) for r in lines.select(net_amount(lines)).collect()] == [6]


def test_other_source_columns_are_carried_along(spark):
    df = spark.sql("select 1 ReturnID, 2 CustomerID, 'x' `a.b`, 3 more")
    assert conform(df, "Returns").columns == ["ReturnID", "CustomerID"]
    assert conform(df, "Returns", others=True).columns == ["ReturnID", "CustomerID", "a.b", "more"]
