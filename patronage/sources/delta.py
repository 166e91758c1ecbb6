"""The table store on Delta Lake, for clusters that have it. Nothing else here needs it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.operators.merge import require_unique
from patronage.sources.store import TableStore


def _delta_table():
    try:
        from delta.tables import DeltaTable
    except ImportError as error:
        raise RuntimeError("the Delta table store needs the delta-spark package") from error
    return DeltaTable


class DeltaStore(TableStore):
    """Same operations, each one transaction of the Delta log instead of a folder of its own."""

    def __init__(self, spark: SparkSession, base: str):
        self._table = _delta_table()
        super().__init__(spark, base, "delta")

    def exists(self, layer: str, name: str) -> bool:
        return self._table.isDeltaTable(self.spark, self.path(layer, name))

    def read(self, layer: str, name: str, where: Column | None = None) -> DataFrame:
        if not self.exists(layer, name):
            raise FileNotFoundError(f"no table {name} in layer {layer} at {self.path(layer, name)}")
        df = self.spark.read.format(self.fmt).load(self.path(layer, name))
        return df if where is None else df.where(where)

    def read_partition(self, layer: str, name: str, partition: Mapping[str, date | str | int]) -> DataFrame:
        rows = self.read(layer, name)
        for column, value in partition.items():
            rows = rows.where(F.col(column) == F.lit(value))
        return rows

    def overwrite(self, df: DataFrame, layer: str, name: str, partition_by: Sequence[str] = ()) -> int:
        path = self.path(layer, name)
        return self._write(
            df,
            lambda d: d.write.mode("overwrite").option("overwriteSchema", "true").partitionBy(*partition_by),
            path,
        )

    def replace_partitions(
        self, df: DataFrame, layer: str, name: str, partition: Mapping[str, date | str | int], evolve: bool = False
    ) -> int:
        """As the base store's; with ``evolve`` Delta itself adds new columns and widens types where the table allows it."""
        literals = {column: F.lit(value) for column, value in partition.items()}
        condition = " AND ".join(f"{column} = '{value}'" for column, value in partition.items())
        return self._write(
            df.drop(*partition),
            lambda d: d.withColumns(literals)
            .write.mode("overwrite")
            .option("replaceWhere", condition)
            .option("mergeSchema", str(evolve).lower())
            .partitionBy(*partition),
            self.path(layer, name),
        )

    def upsert(
        self,
        source: DataFrame,
        layer: str,
        name: str,
        key: str,
        now: datetime,
        keep: Sequence[str] = (),
        key_checked: bool = False,
    ) -> int:
        """As the base store's; returns the rows of the source, each of which is written once."""
        if not key_checked:
            require_unique(source, key)
        stamped = source.withColumn("ModifiedDate", F.lit(now))
        if not self.exists(layer, name):
            return self.overwrite(stamped, layer, name)
        changed = {c: f"new.{c}" for c in stamped.columns if c != key and c not in keep}
        (
            self._table.forPath(self.spark, self.path(layer, name))
            .alias("old")
            .merge(stamped.alias("new"), f"old.{key} = new.{key}")
            .whenMatchedUpdate(set=changed)
            .whenNotMatchedInsertAll()
            .execute()
        )
        return source.count()

    def append(self, df: DataFrame, layer: str, name: str) -> int:
        """Delta itself refuses columns that differ from the table's."""
        return self._write(df, lambda d: d.write.mode("append"), self.path(layer, name))

    def drop_before(self, layer: str, name: str, column: str, cutoff: date) -> list[str]:
        """Deletes the rows before the cutoff; returns their partitions, named as the base store does."""
        table = self._table.forPath(self.spark, self.path(layer, name))
        condition = f"{column} < '{cutoff.isoformat()}'"
        days = self.read(layer, name).where(condition).select(column).distinct().collect()
        table.delete(condition)
        return sorted(f"{column}={r[0]}" for r in days)
