"""What the Delta store asks for. The package is not installed here; a recorder stands in for it."""

import sys
import types
from datetime import date, datetime

import pytest

from patronage.sources.delta import DeltaStore


class Recorder:
    calls: list = []
    present = True

    @classmethod
    def isDeltaTable(cls, spark, path):
        return cls.present

    @classmethod
    def forPath(cls, spark, path):
        cls.calls.append(("forPath", path))
        return cls()

    def __getattr__(self, name):
        def record(*args, **kwargs):
            self.calls.append((name, *args, kwargs) if kwargs else (name, *args))
            return self

        return record


@pytest.fixture
def delta(monkeypatch, spark):
    module = types.ModuleType("delta.tables")
    module.DeltaTable = type("DeltaTable", (Recorder,), {"calls": [], "present": True})
    monkeypatch.setitem(sys.modules, "delta", types.ModuleType("delta"))
    monkeypatch.setitem(sys.modules, "delta.tables", module)
    store = DeltaStore(spark, "/data")
    return store, module.DeltaTable


def test_needs_the_package(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "delta.tables", None)
    with pytest.raises(RuntimeError, match="delta-spark"):
        DeltaStore(spark, "/data")


def test_missing_table(delta):
    store, table = delta
    table.present = False
    assert not store.exists("gold", "dbo.T")
    with pytest.raises(FileNotFoundError, match="dbo.T"):
        store.read("gold", "dbo.T")


def test_upsert_is_a_merge(delta, spark, monkeypatch):
    store, table = delta
    monkeypatch.setattr(DeltaStore, "read", lambda self, *a: spark.range(7))
    source = spark.createDataFrame([(1, "a", date(2020, 1, 1))], "CustomerID long, Name string, CreatedDate date")
    assert store.upsert(source, "gold", "P", "CustomerID", datetime(2024, 1, 1), ("CreatedDate",)) == 1
    with pytest.raises(ValueError, match="occurs more than once"):
        store.upsert(source.unionAll(source), "gold", "P", "CustomerID", datetime(2024, 1, 1))
    named = {call[0]: call[1:] for call in table.calls}
    assert named["forPath"] == ("/data/gold/P",)
    assert named["merge"][1] == "old.CustomerID = new.CustomerID"
    assert named["whenMatchedUpdate"][0]["set"] == {"Name": "new.Name", "ModifiedDate": "new.ModifiedDate"}
    assert "whenNotMatchedInsertAll" in named and "execute" in named


def test_retention_is_a_delete(delta, spark, monkeypatch):
    store, table = delta
    days = spark.sql("SELECT explode(sequence(date'2023-12-30', date'2024-01-03')) AS ProcessDate")
    monkeypatch.setattr(DeltaStore, "read", lambda self, *a: days)
    dropped = store.drop_before("gold", "T", "ProcessDate", date(2024, 1, 2))
    assert dropped == ["ProcessDate=2023-12-30", "ProcessDate=2023-12-31", "ProcessDate=2024-01-01"]
    assert ("delete", "ProcessDate < '2024-01-02'") in table.calls


def test_partition_replacement_is_conditional(delta, spark, monkeypatch):
    store, _ = delta
    seen = {}

    def write(self, df, writer, path):
        seen.update(path=path, columns=df.columns)
        return 3

    monkeypatch.setattr(DeltaStore, "_write", write)
    rows = spark.range(3).selectExpr("id", "date'2024-01-01' AS day")
    assert store.replace_partitions(rows, "gold", "T", {"day": date(2024, 1, 2)}) == 3
    assert seen == {"path": "/data/gold/T", "columns": ["id"]}
