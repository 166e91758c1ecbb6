"""Upsert, replace, retention and paging as plans over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.paging import KeyOrder


def require_unique(df: DataFrame, key: str) -> None:
    """Raises when a key occurs more than once, naming one; reads the key column only."""
    repeated = df.groupBy(key).count().where(F.col("count") > 1).select(key).first()
    if repeated is not None:
        raise ValueError(f"{key} {repeated[0]} occurs more than once")


def upsert(
    target: DataFrame, source: DataFrame, key: str, now: datetime, keep: Sequence[str] = ()
) -> DataFrame:
    """The target after updating matched rows from the source and inserting the others.

    One full outer join on the key. Matched rows take the source's values, nulls included, except for
    the columns in ``keep``; rows touched get ``ModifiedDate`` = ``now``. ``source`` has unique keys and
    every target column but ModifiedDate; ``TableStore.upsert`` checks its keys first, so store a source
    that is costly to compute.
    """
    old = target.select(F.struct(*target.columns).alias("old"), F.col(key))
    new = source.select(F.struct(*source.columns).alias("new"), F.col(key))
    touched, existed = F.col("new").isNotNull(), F.col("old").isNotNull()

    def value(column: str):
        if column == "ModifiedDate":
            return F.when(touched, F.lit(now)).otherwise(F.col("old.ModifiedDate"))
        from_old = existed if column in keep else ~touched
        return F.when(from_old, F.col(f"old.{column}")).otherwise(F.col(f"new.{column}"))

    return old.join(new, key, "full").select(
        *[F.col(key) if c == key else value(c).alias(c) for c in target.columns]
    )


def replace_by_date(history: DataFrame, rows: DataFrame, column: str, day: date) -> DataFrame:
    """The history with the given day's rows replaced; the plan form of ``TableStore.replace_partitions``."""
    return history.where(F.col(column) != F.lit(day)).unionByName(rows)


def retain(history: DataFrame, column: str, cutoff: date) -> DataFrame:
    """Rows on or after the cutoff; the plan form of ``TableStore.drop_before``."""
    return history.where(F.col(column) >= F.lit(cutoff))


def keyset_page(df: DataFrame, key: str, last: object, size: int) -> DataFrame:
    """The next ``size`` rows in key order after ``last``, for readers that page through a table."""
    return df.where(F.col(key) > F.lit(last)).orderBy(key).limit(size)


def next_page_key(df: DataFrame | KeyOrder, key: str, last: object, size: int) -> object:
    """The last key of the page after ``last``, or None when nothing is left.

    Of a table this sorts what is left of it; who asks for one page after the other gives its ``KeyOrder``.
    """
    if isinstance(df, KeyOrder):
        if df.key != key:
            raise ValueError(f"the pages are in the order of {df.key}, not {key}")
        return df.end_after(last, size)
    return keyset_page(df.select(key), key, last, size).agg(F.max(key)).first()[0]


def cluster_by_key(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Hash-partitioned on the key and kept for the steps that follow; unpersist when done.

    The number of partitions is fixed (the session's shuffle partitions by default): adaptive execution
    would otherwise merge them and joins on the key would shuffle again.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, key).persist()
