"""Writing a table page by page in key order, so that a failed write goes on where it stopped.

Each batch replaces a partition of its own, named by its number, and then moves the marker, which holds the number and
the last key. A batch that failed, or whose marker was not moved, is written again in the same place.

Small batches are written several by one job, never more than the same call wrote before them, so a failure costs half of
a call's work at most. What such a job wrote beyond the marker is removed when the write stops or goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.merge import require_unique
from patronage.operators.paging import Pages, after, pages
from patronage.sources.store import TableStore

MARKER, GROUP, BATCH = "_marker.json", "_group.json", "Batch"
BATCH_ROWS = 1_000_000
#: Rows and batches that one job writes at most, unless a single batch has more rows.
GROUP_ROWS, GROUP_BATCHES = BATCH_ROWS, 10_000


def marker(store: TableStore, layer: str, name: str) -> dict | None:
    """The last batch that was written, with its last key as text; none before the first."""
    return store._get(f"{store.path(layer, name)}/{MARKER}")


def write_in_batches(
    store: TableStore, df: DataFrame, layer: str, name: str, key: str, size: int = BATCH_ROWS, done: Callable[[int, int], None] | None = None
) -> int:
    """Writes the rows whose key is beyond the marker, ``size`` at a time; returns how many. ``done`` is told each batch
    and its rows, once the marker is there; without it the marker moves once for each job. Keys are unique and not null."""
    require_unique(df, key)
    if df.where(F.col(key).isNull()).head(1):
        raise ValueError(f"{key} is null in some rows, which no batch could follow")
    _drop_unreached(store, layer, name)
    last, kind = marker(store, layer, name), df.schema[key].dataType
    rest = df if last is None else df.where(after(key, F.lit(last["key"]).cast(kind)))
    found = pages(rest, key, size)
    first, written, most = 0 if last is None else last["batch"] + 1, 0, max(1, min(GROUP_BATCHES, GROUP_ROWS // size))
    n = 0
    while n < found.count:
        group = range(n, min(found.count, n + min(max(n, 1), most)))
        if len(group) == 1:
            written += store.replace_partitions(found.page(n), layer, name, {BATCH: first + n})
        else:
            written += _write_group(store, found, group, layer, name, key, first)
        told = found.numbered(first, BATCH, group if done else group[-1:]).groupBy(BATCH)
        ends = told.agg(F.max(key).cast("string").alias("key"), F.count(F.lit(1)).alias("rows")).collect()  # one row for each batch
        for batch, reached, rows in sorted(ends, key=lambda r: r[BATCH]):
            store._put(f"{store.path(layer, name)}/{MARKER}", {"batch": batch, "key": reached})
            if done:
                try:
                    done(batch, rows)
                except BaseException:
                    _drop_unreached(store, layer, name)
                    raise
        n = group.stop
    return written


def _write_group(store: TableStore, found: Pages, group: range, layer: str, name: str, key: str, first: int) -> int:
    """Pages as batches, each in a file of its own; noted first, for whoever goes on if this stops before the marker moves."""
    batches = range(first + group.start, first + group.stop)
    store._put(f"{store.path(layer, name)}/{GROUP}", {"first": batches[0], "last": batches[-1]})
    numbered = found.numbered(first, BATCH, group).withColumn(BATCH, F.col(BATCH).cast("int"))
    tasks = min(len(group), store.spark.sparkContext.defaultParallelism)
    return store.replace_each(numbered.repartition(tasks, BATCH), layer, name, BATCH, batches, key)


def _drop_unreached(store: TableStore, layer: str, name: str) -> None:
    """Removes the batches that one job wrote and that the marker has not reached."""
    path = store.path(layer, name)
    group, last = store._get(f"{path}/{GROUP}"), marker(store, layer, name)
    if group is not None:
        for batch in range(max(group["first"], last["batch"] + 1 if last else 0), group["last"] + 1):
            store._delete(f"{path}/{BATCH}={batch}")
        store._delete(f"{path}/{GROUP}")


def start_over(store: TableStore, layer: str, name: str) -> None:
    """Forgets the marker, so that the next write begins with the first row."""
    _drop_unreached(store, layer, name)
    store._delete(f"{store.path(layer, name)}/{MARKER}")
