"""Every query beside its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from patronage import oracle
from patronage import queries as registry
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
# Pairing all rows with all rows, and rows handed to Python one by one or in batches.
NEVER = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas")
QUERIES, SQL = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in NEVER if node in plan]
    assert difference(df, con, SQL[name]) is None


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
