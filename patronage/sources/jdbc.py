"""Reading database tables in parallel key ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from patronage.contracts import SOURCES

FETCH_ROWS = "10000"


def sql_server_url(host: str, database: str) -> str:
    return f"jdbc:sqlserver://{host};databaseName={database};encrypt=true;trustServerCertificate=false"


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str] | None = None,
    *,
    column: str | None = None,
    num_partitions: int = 1,
    bounds: tuple[object, object] | None = None,
    predicates: Sequence[str] | None = None,
) -> DataFrame:
    """A table, read once. Nothing is counted here; writers report their own row counts.

    With ``column`` the read splits into ``num_partitions`` key ranges; where ``bounds`` is not given the
    database returns the key's minimum and maximum. Where keys are too uneven for equal ranges, pass
    ``predicates``: one non-overlapping condition per partition.
    """
    options = {"fetchsize": FETCH_ROWS, **(properties or {})}
    if predicates:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=options)
    if column is None or num_partitions <= 1:
        return spark.read.jdbc(url, table, properties=options)
    low, high = bounds or _key_range(spark, url, table, column, options)
    if low is None:
        return spark.read.jdbc(url, table, properties=options)
    return spark.read.jdbc(
        url,
        table,
        column=column,
        lowerBound=low,
        upperBound=high,
        numPartitions=num_partitions,
        properties=options,
    )


def _key_range(
    spark: SparkSession, url: str, table: str, column: str, options: Mapping[str, str]
) -> tuple[object, object]:
    query = f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}) key_range"
    row = spark.read.jdbc(url, query, properties=dict(options)).first()
    return row[0], row[1]


@dataclass(frozen=True)
class TableRead:
    """How one table is read: its own number of key ranges, their bounds, another column, or predicates instead."""

    num_partitions: int | None = None
    column: str | None = None
    bounds: tuple[object, object] | None = None
    predicates: tuple[str, ...] = ()


def key_predicates(key: str, edges: Sequence[object], hot: Mapping[object, tuple[str, int]] | None = None) -> tuple[str, ...]:
    """Non-overlapping conditions that cover a table: key ranges between the edges, null keys, and, for each hot key,
    ``parts`` remainders of a second numeric column, given as (column, parts)."""
    hot = dict(hot or {})
    value = lambda v: "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
    rest = f" AND {key} NOT IN ({', '.join(value(k) for k in hot)})" if hot else ""
    steps = [None, *edges, None]
    ranges = []
    for low, high in zip(steps, steps[1:]):
        sides = [f"{key} >= {value(low)}"] * (low is not None) + [f"{key} < {value(high)}"] * (high is not None)
        ranges.append((" AND ".join(sides) or f"{key} IS NOT NULL") + rest)
    split = []
    for k, (second, parts) in hot.items():
        split += [f"{key} = {value(k)} AND {second} % {parts} IN ({j}, {j - parts})" for j in range(1, parts)]
        split.append(f"{key} = {value(k)} AND ({second} % {parts} = 0 OR {second} IS NULL)")
    return (*ranges, *split, f"{key} IS NULL")


class JdbcSource:
    """The seven contract tables in a database, each split on its key unless ``reads`` says otherwise for it."""

    def __init__(
        self,
        spark: SparkSession,
        url: str,
        properties: Mapping[str, str] | None = None,
        schema: str = "dbo",
        num_partitions: int = 16,
        reads: Mapping[str, TableRead] | None = None,
    ):
        self.spark = spark
        self.url = url
        self.properties = dict(properties or {})
        self.schema = schema
        self.num_partitions = num_partitions
        self.reads = dict(reads or {})
        if unknown := self.reads.keys() - SOURCES.keys():
            raise ValueError(f"no such source: {', '.join(sorted(unknown))}")

    def table(self, name: str) -> DataFrame:
        how = self.reads.get(name, TableRead())
        return read_jdbc(
            self.spark,
            self.url,
            f"{self.schema}.{name}",
            self.properties,
            column=how.column or SOURCES[name].key,
            num_partitions=how.num_partitions or self.num_partitions,
            bounds=how.bounds,
            predicates=how.predicates,
        )
