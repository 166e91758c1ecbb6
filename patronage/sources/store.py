"""Layered tables on any Hadoop file system.

Three kinds of table, by how they change:

* versioned: written whole (``overwrite``) or by buckets of the key (``upsert``). Each write makes a new
  version folder, which counts once its commit record is written after the job, so a plan may read the table
  it replaces and a failed write leaves the old version in force. The record is the store's own and depends on
  no marker that a cluster may switch off. An upsert writes the buckets it touches; its record names, for each
  bucket, the version that holds it.
* partitioned: replaced partition by partition (``replace_partitions``), expired by dropping partitions.
* appended: only ever added to (``append``), or kept by run (``replace_run``), where a run that is repeated under one
  id replaces its own rows.

Writers return the number of rows written, observed during the write itself. A table's schema is kept beside its
data, so every write is checked against it and partition values are read back in their own type.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime
from functools import reduce
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patronage.operators.merge import upsert
from patronage.sources import evolution

COMMIT, SCHEMA, OLDER = "_commit.json", "_schema.json", "_older.json"
BUCKET = "key_bucket"
#: Rows that a bucket of an upserted table is made for, and the fewest buckets. Their number is fixed when the table is
#: first written and kept with it.
BUCKET_ROWS, LEAST_BUCKETS = 250_000, 32
#: Rows that one task writes of a bucket, about; a bucket that outgrew this is written by several.
TASK_ROWS = 1_000_000
RUN = "RunID"


class TableStore:
    def __init__(self, spark: SparkSession, base: str, fmt: str = "parquet"):
        self.spark = spark
        self.base = base.rstrip("/")
        self.fmt = fmt

    # Paths and presence

    def path(self, layer: str, name: str) -> str:
        return f"{self.base}/{layer}/{name.replace('.', '_')}"

    def exists(self, layer: str, name: str) -> bool:
        return self._current(layer, name) is not None

    def _fs(self, path: str):
        jvm = self.spark._jvm
        handle = jvm.org.apache.hadoop.fs.Path(path)
        return handle.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), handle

    def _children(self, path: str) -> list[str]:
        fs, handle = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(handle)) if fs.exists(handle) else []

    def _delete(self, path: str) -> None:
        fs, handle = self._fs(path)
        fs.delete(handle, True)

    def _put(self, path: str, value: dict) -> None:
        """A small file, complete once it can be seen."""
        fs, handle = self._fs(f"{path}.new")
        stream = fs.create(handle, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs.delete(target, False)
        if not fs.rename(handle, target):
            raise OSError(f"{path} could not be written")

    def _get(self, path: str) -> dict | None:
        fs, handle = self._fs(path)
        if not fs.exists(handle):
            return None
        stream = fs.open(handle)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _versions(self, path: str) -> list[str]:
        return [c for c in self._children(path) if c.startswith("v") and c[1:].isdigit()]

    def _committed(self, path: str) -> list[tuple[str, dict]]:
        """The versions that count, oldest first, with their records."""
        records = [(v, self._get(f"{path}/{v}/{COMMIT}")) for v in self._versions(path)]
        return [(v, record) for v, record in records if record is not None]

    def _current(self, layer: str, name: str) -> str | None:
        """The newest version that counts, or the table folder when it holds data."""
        path = self.path(layer, name)
        committed = self._committed(path)
        if committed:
            return f"{path}/{committed[-1][0]}"
        children = self._children(path)
        if any(c.startswith("v") and c[1:].isdigit() for c in children):
            raise OSError(f"{path} has versions but none was committed; overwrite the table or remove its folder")
        data = [c for c in children if c[0] not in "._" or "=" in c]
        return path if data else None

    def _schema(self, layer: str, name: str) -> StructType | None:
        """The schema kept for a table that is not versioned."""
        kept = self._get(f"{self.path(layer, name)}/{SCHEMA}")
        return None if kept is None else StructType.fromJson(kept)

    # Reading

    def read(self, layer: str, name: str, where: Column | None = None) -> DataFrame:
        folder = self._current(layer, name)
        if folder is None:
            raise FileNotFoundError(f"no table {name} in layer {layer} at {self.path(layer, name)}")
        df = self._load(layer, name, folder)
        return df if where is None else df.where(where)

    def _load(self, layer: str, name: str, folder: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """A table's current content, or some buckets of it."""
        path = self.path(layer, name)
        record = None if folder == path else self._get(f"{folder}/{COMMIT}")
        schema = self._schema(layer, name) if record is None else StructType.fromJson(record["schema"])
        older = self._older(path) if record is None and schema is not None else evolution.Older()
        if older.all():
            return self._united(path, schema, older)
        reader = self.spark.read.format(self.fmt)
        if schema is not None:
            reader = reader.schema(schema)
        if record is None or record["buckets"] is None:
            return reader.load(folder)
        holders = {int(b): v for b, v in record["buckets"].items() if buckets is None or int(b) in buckets}
        if not holders:
            return self.spark.createDataFrame([], schema)
        return reader.load([f"{path}/{v}/{BUCKET}={b}" for b, v in sorted(holders.items())])

    def read_partition(self, layer: str, name: str, partition: Mapping[str, date | str | int]) -> DataFrame:
        """One partition, given by its values. The others are not even listed."""
        path = self.path(layer, name)
        folder = self._partition_path(path, partition)
        if not self._children(folder):
            raise FileNotFoundError(f"no partition {folder}")
        reader, schema = self.spark.read.format(self.fmt).option("basePath", path), self._schema(layer, name)
        if schema is None:
            return reader.load(folder)
        own = self._older(path).of(folder[len(path) + 1 :])
        return reader.schema(schema).load(folder) if own is None else evolution.fitted(reader.schema(own).load(folder), schema)

    def _older(self, path: str) -> evolution.Older:
        return evolution.Older.from_json(self._get(f"{path}/{OLDER}"))

    def _partitions(self, path: str, schema: StructType) -> list[str]:
        """Folders of the partitions below the table's, at any depth."""
        found, open_ = [], [""]
        while open_:
            at = open_.pop()
            inner = [f"{at}/{c}".lstrip("/") for c in self._children(f"{path}/{at}") if "=" in c and c.split("=")[0] in schema.names]
            open_ += inner
            if at and not inner:
                found.append(at)
        return sorted(found)

    def _united(self, path: str, schema: StructType, older: evolution.Older) -> DataFrame:
        """The partitions of each schema read with it, and given the current one."""
        there = set(self._partitions(path, schema))
        groups = [*((s, p & there) for s, p in older.held), (schema, there - older.all())]
        reader = lambda s: self.spark.read.format(self.fmt).schema(s).option("basePath", path)
        parts = [evolution.fitted(reader(s).load([f"{path}/{x}" for x in sorted(p)]), schema) for s, p in groups if p]
        return reduce(DataFrame.unionByName, parts)

    def _partition_path(self, path: str, partition: Mapping[str, date | str | int]) -> str:
        """The folder of a partition, its name escaped as Spark's writer does."""
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return "/".join([path, *(escaped(column, str(value)) for column, value in partition.items())])

    def read_table(self, table: str) -> DataFrame:
        return self.spark.read.table(table)

    # Writing

    def overwrite(self, df: DataFrame, layer: str, name: str, partition_by: Sequence[str] = ()) -> int:
        path = self.path(layer, name)
        version = self._next_version(path)
        rows = self._write(df, lambda d: d.write.mode("error").partitionBy(*partition_by), f"{path}/{version}")
        self._commit(path, version, df.schema, None)
        return rows

    def _next_version(self, path: str) -> str:
        versions = self._versions(path)
        return f"v{int(versions[-1][1:]) + 1 if versions else 1:08d}"

    def _commit(self, path: str, version: str, schema: StructType, buckets: dict[int, str] | None, more: Mapping = MappingProxyType({})) -> None:
        """Makes a version count, then removes what neither it nor the version before it holds.

        The version just replaced stays for plans that still read it.
        """
        held = None if buckets is None else {str(b): v for b, v in sorted(buckets.items())}
        self._put(f"{path}/{version}/{COMMIT}", {"schema": schema.jsonValue(), "buckets": held, **more})
        committed = self._committed(path)[-2:]
        used = {v for v, _ in committed}
        parts = {f"{v}/{BUCKET}={b}" for _, r in committed for b, v in (r["buckets"] or {}).items()}
        for old in self._versions(path):
            if old in used:
                continue
            mine = [c for c in self._children(f"{path}/{old}") if c.startswith(f"{BUCKET}=")]
            if not any(f"{old}/{c}" in parts for c in mine):
                self._delete(f"{path}/{old}")
                continue
            for c in mine:
                if f"{old}/{c}" not in parts:
                    self._delete(f"{path}/{old}/{c}")

    def replace_run(self, df: DataFrame, layer: str, name: str, run_id: str) -> int:
        """Makes ``df`` all that a run left in the table, whatever an earlier attempt under the same id left there."""
        return self.replace_partitions(df, layer, name, {RUN: run_id}, evolve=True)

    def append(self, df: DataFrame, layer: str, name: str) -> int:
        self._check_schema(df, layer, name)
        rows = self._write(df, lambda d: d.write.mode("append"), self.path(layer, name))
        self._keep_schema(df.schema, layer, name)
        return rows

    def replace_partitions(
        self, df: DataFrame, layer: str, name: str, partition: Mapping[str, date | str | int], evolve: bool = False
    ) -> int:
        """Makes ``df`` the content of one partition, given by its values, and leaves all others as they are.

        With ``evolve`` its columns may differ from the table's: those it lacks are null, new ones join the
        table and types widen; see ``evolution``. Without it, and where no type holds both, that raises.
        The partition's columns are set here, as literals above the row count: Spark then knows that a
        task writes one partition only and does not sort the rows by it.
        """
        literals = {column: F.lit(value) for column, value in partition.items()}
        rows_only, path = df.drop(*partition), self.path(layer, name)
        folder = self._partition_path(path, partition)
        whole = rows_only.withColumns(literals)
        if evolve and self.exists(layer, name):
            current = self._evolved(whole.schema, layer, name)
            rows_only = evolution.fitted(whole, current).drop(*partition)
            whole = rows_only.withColumns(literals)
        self._check_schema(whole, layer, name)
        older = self._older(path)
        if older.drop([folder[len(path) + 1 :]]):  # what is there now is about to go, and wider types read it until then
            self._put(f"{path}/{OLDER}", older.json())
        before = set(self._children(folder))
        rows = self._write(
            rows_only,
            lambda d: d.withColumns(literals)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partition),
            path,
        )
        self._keep_schema(whole.schema, layer, name)
        if not set(self._children(folder)) - before:  # no new file: nothing was written, so nothing replaced either
            self._delete(folder)
            return 0
        return rows

    def replace_each(self, df: DataFrame, layer: str, name: str, column: str, values: Sequence[int], order: str) -> int:
        """Makes the rows of each value of ``column`` the content of that value's partition, all in one job, in files sorted by
        ``order``. ``df`` has rows of all the values and of no others; partitions of others stay as they are."""
        path = self.path(layer, name)
        self._check_schema(df, layer, name)
        older = self._older(path)
        if older.all() and older.drop([self._partition_path(path, {column: v})[len(path) + 1 :] for v in values]):
            self._put(f"{path}/{OLDER}", older.json())
        rows = self._write(
            df,
            # Sorted by the partition first, as the writer needs it, or it would sort again.
            lambda d: d.sortWithinPartitions(column, order)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(column),
            path,
        )
        self._keep_schema(df.schema, layer, name)
        return rows

    def _evolved(self, given: StructType, layer: str, name: str) -> StructType:
        """The table's schema after it met the given one. Partitions stored so far are noted with the schema they have
        before the current one changes, so whatever fails in between leaves a table that reads as before."""
        path, kept = self.path(layer, name), self._schema(layer, name)
        stored = kept if kept is not None else self.read(layer, name).schema
        current = evolution.united(stored, given)
        if not evolution.same(current, stored):
            older = self._older(path)
            older.add(stored, self._partitions(path, stored))
            self._put(f"{path}/{OLDER}", older.json())
            self._put(f"{path}/{SCHEMA}", current.jsonValue())
        return current

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
        """Updates matched rows, inserts the others; see ``operators.merge.upsert``. Returns the rows written.

        Rows lie in buckets by the hash of their key, sorted by it, with a Bloom filter on it. Only buckets that occur in
        the source are read and written; the others stay as they are. Each is written by as many tasks as its rows need.
        One grouping of the source's keys finds repeated ones, which raise, and the buckets; ``key_checked`` says the
        caller has made sure that keys are unique. The source is read twice, so store a costly one.
        """
        path = self.path(layer, name)
        folder = self._current(layer, name)
        record = self._get(f"{folder}/{COMMIT}") if folder not in (None, path) else None
        dealt_before = record is not None and record["buckets"] is not None
        count = record.get("count", 64) if dealt_before else None
        rows, touched = self._keys(source, key, count, key_checked)
        if not dealt_before:
            count = LEAST_BUCKETS
            while count * BUCKET_ROWS < rows:
                count *= 2
        bucket = self._bucket(F.col(key), count)
        held = {int(b): v for b, v in record["buckets"].items()} if dealt_before else {}
        if folder is None:
            merged = source.withColumn("ModifiedDate", F.lit(now))
        else:
            merged = upsert(self._load(layer, name, folder, touched if dealt_before else None), source, key, now, keep)
        version = self._next_version(path)
        usual = max(record.get("bucket_rows", 0) if dealt_before else 0, -(-rows // count))
        part = F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(-(-usual // TASK_ROWS) or 1))
        dealt = merged.withColumn(BUCKET, bucket).repartition(F.col(BUCKET), part).sortWithinPartitions(BUCKET, key)
        bloom = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(min(TASK_ROWS, max(1000, 2 * usual)))}
        rows = self._write(dealt, lambda d: d.write.mode("error").options(**bloom).partitionBy(BUCKET), f"{path}/{version}")
        new = {int(c.split("=")[1]): version for c in self._children(f"{path}/{version}") if c.startswith(f"{BUCKET}=")}
        found = {"count": count, "bucket_rows": max(usual, -(-rows // max(1, len(new))))}
        self._commit(path, version, merged.schema, held | new, found)
        return rows

    @staticmethod
    def _bucket(key: Column, count: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def _keys(self, source: DataFrame, key: str, count: int | None, checked: bool) -> tuple[int, list[int]]:
        """How many rows the source has and which buckets occur in it, from its keys alone."""
        which = F.collect_set(self._bucket(F.col(key), count)) if count else F.array()  # `count` values at most
        if checked:
            found = source.select(key).agg(F.count(F.lit(1)).alias("rows"), F.lit(1).alias("most"), F.lit(None).alias("name"), which.alias("buckets"))
        else:
            found = source.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
                F.sum("n").alias("rows"), F.max("n").alias("most"), F.max_by(F.col(key), "n").alias("name"), which.alias("buckets")
            )
        row = found.first()
        if (row["most"] or 0) > 1:
            raise ValueError(f"{key} {row['name']} occurs more than once")
        return row["rows"] or 0, list(row["buckets"])

    def lookup(self, layer: str, name: str, key: str, value: object) -> DataFrame:
        """The rows of one key of an upserted table: one bucket's files are listed, and of these the key's statistics and
        Bloom filter leave those that may hold it."""
        folder = self._current(layer, name)
        if folder is None:
            raise FileNotFoundError(f"no table {name} in layer {layer} at {self.path(layer, name)}")
        record = self._get(f"{folder}/{COMMIT}") if folder != self.path(layer, name) else None
        if record is None or record["buckets"] is None:
            return self._load(layer, name, folder).where(F.col(key) == F.lit(value))
        kind = StructType.fromJson(record["schema"])[key].dataType
        number = self.spark.range(1).select(self._bucket(F.lit(value).cast(kind), record.get("count", 64))).first()[0]
        return self._load(layer, name, folder, [number]).where(F.col(key) == F.lit(value))

    def drop_before(self, layer: str, name: str, column: str, cutoff: date) -> list[str]:
        """Deletes the date partitions strictly before the cutoff; no data file is read."""
        path = self.path(layer, name)
        prefix = f"{column}="
        expired = [c for c in self._children(path) if c.startswith(prefix) and c[len(prefix) :] < cutoff.isoformat()]
        for child in expired:
            self._delete(f"{path}/{child}")
        older = self._older(path)
        if older.drop(p for p in older.all() if p.split("/")[0] in expired):
            self._put(f"{path}/{OLDER}", older.json())
        return expired

    def save_table(self, df: DataFrame, table: str, path: str | None = None) -> None:
        """A catalog table, in the warehouse unless a path is given."""
        writer = df.write.mode("overwrite").format(self.fmt)
        (writer.option("path", path) if path else writer).saveAsTable(table)

    def save_bucketed(self, df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
        """A catalog table bucketed and sorted on the key: joins and groupings on it need no shuffle. With a path it
        lies there and not in the warehouse."""
        writer = df.repartition(buckets, key).write.mode("overwrite").format(self.fmt).bucketBy(buckets, key).sortBy(key)
        (writer.option("path", path) if path else writer).saveAsTable(table)

    def _write(self, df: DataFrame, writer: Callable, path: str) -> int:
        seen = Observation()
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        writer(observed).format(self.fmt).save(path)
        found = seen.get
        return int(found["rows"]) if "rows" in found else 0  # no count comes from a plan known to be empty

    def _keep_schema(self, schema: StructType, layer: str, name: str) -> None:
        if self._schema(layer, name) is None:
            self._put(f"{self.path(layer, name)}/{SCHEMA}", schema.jsonValue())

    def _check_schema(self, df: DataFrame, layer: str, name: str) -> None:
        kept = self._schema(layer, name)
        if kept is None and not self.exists(layer, name):
            return
        schema = kept if kept is not None else self.read(layer, name).schema
        stored = {f.name: f.dataType for f in schema}
        given = {f.name: f.dataType for f in df.schema}
        if stored != given:
            differing = sorted(
                c for c in stored.keys() | given.keys() if stored.get(c) != given.get(c)
            )
            raise ValueError(f"{name}: columns differ from the stored table: {', '.join(differing)}")
