"""Helpers shared by the operators: shipping code, scratch tables and Arrow text buffers."""

from __future__ import annotations

import ctypes
import functools
import gc
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patronage.sources.durable import scratch_path

__all__ = ["add_columns", "column_ref", "one_at_a_time", "release", "ship", "sub_batches", "table", "text_column", "trim", "written"]

_SHIPPED = "_patronage_shipped"


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors, once per context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='patronage-code-')}/{root.name}", "zip", root.parent, root.name)
    context.addPyFile(archive)
    setattr(context, _SHIPPED, True)


_HELD: dict = {}


def one_at_a_time(make: Callable) -> Callable:
    """Keeps what `make` returned between a worker's tasks, until it or another function so marked makes something else."""

    @functools.wraps(make)
    def held(*key):
        key = (make.__module__, make.__name__, *key)
        if key not in _HELD:
            release()
            _HELD[key] = make(*key[2:])
        return _HELD[key]

    return held


def release() -> None:
    """Gives back what earlier operators keep in this worker, to the system as well, since other workers share its memory."""
    if not _HELD:
        return
    _HELD.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Gives memory that is free in this worker back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    to_system = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if to_system:
        to_system(0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def column_ref(name: str) -> Column:
    """The column of that name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: computed once, read back column by column, safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another and the n + 1 offsets between them. Null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("")
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def sub_batches(values: pa.Array, limit: int):
    """Slices of whole texts, or lists, of about `limit` bytes, so that memory follows the limit and not the batch size."""
    if pa.types.is_struct(values.type):  # a text and what belongs to it
        _, at = text_column(values.field(0))
    elif pa.types.is_list(values.type):
        at = values.offsets.to_numpy().astype(np.int64) * (values.type.value_type.bit_width // 8)
    else:
        _, at = text_column(values)
    start = 0
    while start < len(values):
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield values.slice(start, end - start)
        start = end


def add_columns(df: DataFrame, source: str, added: str, make: Callable, step_bytes: int) -> DataFrame:
    """`df` with columns computed in Python from a text or list column, in steps of about `step_bytes` of it.

    `added` is the DDL of the new columns. `make` is called once in each task; it returns a function from an array to
    the list of new arrays. All other columns pass through as they are; a new column replaces one of the same name.
    """
    ship(df.sparkSession)
    names = [f.name for f in StructType.fromDDL(added)]
    kept = [c for c in df.columns if c not in names or c == source]
    fed = df.select(*[column_ref(c).alias(f"c{k}") for k, c in enumerate(kept)])  # names with dots are not found in there
    out = [c for c in kept if c not in names]
    inner = [f"c{kept.index(c)}" for c in out]
    schema = StructType([*fed.select(*inner).schema, *StructType.fromDDL(added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            begin = 0
            for part in sub_batches(batch.column(kept.index(source)), step_bytes):
                rows = batch.slice(begin, len(part))
                begin += len(part)
                yield pa.RecordBatch.from_arrays([*(rows.column(kept.index(c)) for c in out), *compute(part)], names=[*inner, *names])
        trim()

    return fed.mapInArrow(run, schema).toDF(*out, *names)
