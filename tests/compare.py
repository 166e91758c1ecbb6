"""Runs queries beside their SQL and compares rows. Usable from tests and as a script."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _normal(value):
    if isinstance(value, float) and (math.isnan(value) or value == 0.0):
        return None if math.isnan(value) else 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_normal(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    spark_names, spark_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    sql_names, sql_rows = _rows([d[0] for d in result.description], result.fetchall())
    if spark_names != sql_names:
        return f"columns {spark_names} against {sql_names}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows against {len(sql_rows)}"
    for left, right in zip(spark_rows, sql_rows):
        if left != right:
            pairs = [(n, a, b) for n, a, b in zip(spark_names, left, right) if a != b]
            return f"first difference {pairs} in {left}"
    return None


def main(folder: str, *only: str) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle, failed = entry.oracle_sql(), 0
    queries = entry.queries()
    print("without query:", sorted(oracle.keys() - queries.keys()))
    for name, query in queries.items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            df = query(spark, folder)
            problem = difference(df, con, oracle[name]) if name in oracle else f"no SQL, {df.count()} rows"
        except Exception as error:  # reported, and the next query runs
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{time.time() - started:6.2f} {name}: {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
