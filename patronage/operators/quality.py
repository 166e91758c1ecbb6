"""Table checks. Each returns a small frame: what was checked, what was found, whether it passed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from patronage.functions import fixed_values as fx


def row_counts(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Source rows beside stored rows for every named table, in one query."""
    sides = []
    for name, (source, stored) in pairs.items():
        for column, frame in (("source_rows", source), ("stored_rows", stored)):
            counted = frame.agg(F.count(F.lit(1)).alias("rows"))
            sides.append(counted.select(F.lit(name).alias("table_name"), F.lit(column).alias("side"), "rows"))
    counts = (
        reduce(DataFrame.unionAll, sides)
        .groupBy("table_name")
        .pivot("side", ["source_rows", "stored_rows"])
        .agg(F.sum("rows"))
    )
    return counts.withColumn("passed", F.col("source_rows") == F.col("stored_rows"))


def segment_domains(segments: DataFrame, domains: Mapping[str, Sequence[str]] = fx.SEGMENT_DOMAINS) -> DataFrame:
    """Values outside the allowed set, nulls included, per segment column; all columns in one pass."""
    outside = [
        F.count_if(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).alias(column)
        for column, allowed in domains.items()
    ]
    return (
        segments.agg(*outside)
        .unpivot([], list(domains), "column_name", "invalid_rows")
        .withColumn("passed", F.col("invalid_rows") == 0)
    )


def retention(history: DataFrame, column: str, cutoff: date) -> DataFrame:
    """Rows older than the cutoff; none may be left."""
    expired = F.count_if(F.col(column) < F.lit(cutoff))
    return history.agg(expired.alias("expired_rows")).withColumn("passed", F.col("expired_rows") == 0)


def without_orders(base: DataFrame, summary: DataFrame) -> DataFrame:
    """How many base customers have no completed order."""
    return base.join(summary.select("CustomerID"), "CustomerID", "left_anti").agg(
        F.count(F.lit(1)).alias("customers_without_orders")
    )


def expected_values(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Differences from expected sample rows: one row per key and column, a missing key included.

    Values are compared as values, in the type both sides share, so 100.00 equals 100; texts are for display.
    """
    columns = [c for c in expected.columns if c != key]
    sample = expected.select(F.col(key), *[F.col(c).alias(f"want_{c}") for c in columns])
    found = actual.select(F.col(key), F.lit(True).alias("present"), *[F.col(c).alias(f"got_{c}") for c in columns])
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"want_{c}").cast("string").alias("expected"),
                F.col(f"got_{c}").cast("string").alias("actual"),
                F.col(f"want_{c}").eqNullSafe(F.col(f"got_{c}")).alias("equal"),
            )
            for c in columns
        ]
    )
    return (
        sample.join(found, key, "left")
        .select(F.col(key), F.col("present").isNotNull().alias("present"), F.inline(pairs))
        .where(~F.col("present") | ~F.col("equal"))
        .drop("equal")
    )


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side missing from the other, repeats counted, by one grouping of both sides' rows."""
    columns = left.columns
    if sorted(columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {', '.join(sorted(set(columns) ^ set(right.columns)))}")
    both = left.withColumn("surplus", F.lit(1)).unionByName(right.withColumn("surplus", F.lit(-1)))
    surplus = both.groupBy(*columns).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")
    side = F.when(F.col("surplus") > 0, "left").otherwise("right")
    # a row for each copy, in two steps, so that no array is as long as a row is often
    step, left_over = 1 << 12, F.abs("surplus") - 1
    coarse = surplus.select(*columns, side.alias("only_in"), left_over.alias("__last"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(abs(surplus) - 1) div {step}"))).alias("__part"))
    fine = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(step - 1), F.col("__last") - F.col("__part") * step)))
    return coarse.select(*columns, "only_in", fine.alias("__copy")).drop("__copy")


def bucket_sums(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows of each bucket of the key's hash, and two sums of their hashes that do not depend on the order."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    # a hash passes over nulls, so where they are is hashed as well
    row = lambda seed: F.xxhash64(*columns, *[c.isNull() for c in columns], F.lit(seed)).cast("decimal(20,0)")
    return df.groupBy(_key_bucket(key, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row(1)).cast("decimal(38,0)").alias("sum1"), F.sum(row(2)).cast("decimal(38,0)").alias("sum2")
    )


def _key_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def differing_buckets(left: DataFrame, right: DataFrame, key: str, buckets: int = 4096) -> list[int]:
    """Buckets of the key in which the sides' sums differ. Each task sends one row for each of its buckets."""
    sums = [bucket_sums(df, key, buckets) for df in (left, right)]
    signed = sums[0].unionByName(sums[1].select("bucket", *[(-F.col(c)).alias(c) for c in ("rows", "sum1", "sum2")]))
    added = signed.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("rows", "sum1", "sum2")])
    return sorted(r["bucket"] for r in added.where("rows <> 0 or sum1 <> 0 or sum2 <> 0").select("bucket").collect())


def reconcile_by_key(left: DataFrame, right: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """The rows that ``reconcile`` gives. Sums of row hashes by bucket of the key come first, and only rows of buckets
    that differ are compared; where the tables agree, no row of them is shuffled."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {', '.join(sorted(set(left.columns) ^ set(right.columns)))}")
    right = right.select(*left.columns)
    same_types = all(left.schema[c].dataType == right.schema[c].dataType for c in left.columns)
    if not same_types:
        return reconcile(left, right)
    found = differing_buckets(left, right, key, buckets)
    if len(found) == buckets:
        return reconcile(left, right)
    among = _key_bucket(key, buckets).isin(found) if found else F.lit(False)
    return reconcile(left.where(among), right.where(among))


def stratified_sample(df: DataFrame, group: str, key: str, size: int, salt: str = "") -> DataFrame:
    """Of every group the ``size`` rows whose keys have the smallest digest: the same rows whenever the keys are the same,
    whatever the order or the partitions. A task sends at most ``size`` rows of a group. Null is a group like others."""
    digest = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary"))
    first = Window.partitionBy(group).orderBy(digest.asc_nulls_first(), key)
    return df.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= size).drop("__rank")


def schema_differences(df: DataFrame, schema: StructType, optional: Sequence[str] = ()) -> DataFrame:
    """Columns that are missing, unexpected or of another type: one row each. No data is read."""
    given = {f.name: f.dataType.simpleString() for f in df.schema}
    wanted = {f.name: f.dataType.simpleString() for f in schema}
    rows = [
        (c, wanted.get(c), given.get(c))
        for c in dict.fromkeys([*wanted, *given])
        if wanted.get(c) != given.get(c) and not (c in optional and c not in given)
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, expected_type string, actual_type string")


def schema_catalog(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Column names, types and nullability of the given frames. No data is read."""
    spark = next(iter(frames.values())).sparkSession
    rows = [
        (table, ordinal, field.name, field.dataType.simpleString(), field.nullable)
        for table, frame in frames.items()
        for ordinal, field in enumerate(frame.schema)
    ]
    return spark.createDataFrame(
        rows, "table_name string, ordinal int, column_name string, data_type string, nullable boolean"
    )
