"""The whole run, from sources to gold tables and the run report."""

from __future__ import annotations

import argparse
import sys
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from patronage.functions import fixed_values as fx
from patronage.params import FULL, INCREMENTAL, RunParams
from patronage.plans.layers import Source, run_bronze, run_gold, run_silver
from patronage.plans.runlog import RunLog, failed_row
from patronage.sources.delta import DeltaStore
from patronage.sources.durable import shared_dir
from patronage.sources.jdbc import JdbcSource, TableRead, sql_server_url
from patronage.sources.star_schema import StarSchema
from patronage.sources.store import TableStore

REPORT_SCHEMA = (
    "status string, process_date date, process_type string, "
    "layers array<struct<layer: string, status: string, tables: array<string>>>, "
    "error string, started_at timestamp, completed_at timestamp, duration_seconds double"
)
LAYERS = ("bronze", "silver", "gold")


def run(store: TableStore, source: Source, p: RunParams) -> dict:
    """Runs all layers and returns the report. A failure leaves a failed row and the log, then raises. A run repeated
    under the same id replaces its summary and log."""
    shared_dir(store.spark)  # gold needs it; a cluster without one is told before bronze starts
    log = RunLog(p)
    layers = {layer: {"status": "Not Run", "tables": []} for layer in LAYERS}
    report = {"status": fx.STATUS_SUCCESS, "layers": layers, "error": None, "started_at": p.started_at}
    current = LAYERS[0]
    try:
        frames = run_bronze(store, source, p, log)
        layers["bronze"] = {"status": fx.STATUS_SUCCESS, "tables": sorted(frames)}
        current = "silver"
        frames = run_silver(store, frames, p, log)
        layers["silver"] = {"status": fx.STATUS_SUCCESS, "tables": sorted(frames)}
        current = "gold"
        frames = run_gold(store, frames, p, log)
        layers["gold"] = {"status": fx.STATUS_SUCCESS, "tables": sorted(frames)}
    except Exception as error:
        layers[current]["status"] = fx.STATUS_FAILED
        report.update(status=fx.STATUS_FAILED, error=str(error))
        failed = failed_row(store.spark, p, error, log.steps[-1].name, log.elapsed_ms())
        store.replace_run(failed.coalesce(1), "gold", "CustomerAnalyticsSummary", log.run_id)
        raise
    finally:
        report["completed_at"] = datetime.now()
        report["duration_seconds"] = (report["completed_at"] - p.started_at).total_seconds()
        log.save(store)
        if p.debug_mode:
            target = store.path("log", f"report_{p.data_date}_{p.process_type}")
            report_frame(store.spark, report, p).coalesce(1).write.mode("overwrite").json(target)
    return report


def report_frame(spark: SparkSession, report: dict, p: RunParams) -> DataFrame:
    layers = [(layer, entry["status"], entry["tables"]) for layer, entry in report["layers"].items()]
    row = (
        report["status"],
        p.data_date,
        p.process_type,
        layers,
        report["error"],
        report["started_at"],
        report["completed_at"],
        report["duration_seconds"],
    )
    return spark.createDataFrame([row], REPORT_SCHEMA)


def session(name: str) -> SparkSession:
    """A session with adaptive execution and skew splitting on, and checkpoints removed once unused;
    everything else is the cluster's choice."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description="Customer analytics run")
    parser.add_argument("--store", required=True, help="base folder of the layered tables")
    parser.add_argument("--delta", action="store_true", help="keep the tables in Delta Lake")
    place = parser.add_mutually_exclusive_group(required=True)
    place.add_argument("--star-schema", help="folder of star schema Parquet files")
    place.add_argument("--sql-server", metavar="HOST/DATABASE", help="database to ingest from")
    parser.add_argument("--user")
    parser.add_argument("--password-file")
    parser.add_argument("--read-partitions", type=int, default=16)
    parser.add_argument(
        "--read-partitions-for", action="append", default=[], metavar="TABLE=N", help="key ranges of one table; repeat"
    )
    parser.add_argument("--process-date", type=date.fromisoformat, help="YYYY-MM-DD; yesterday when left out")
    parser.add_argument("--process-type", choices=(FULL, INCREMENTAL), default=FULL)
    parser.add_argument("--run-id", default="", help="name of this run; a repeated run replaces what it left")
    parser.add_argument("--keep-state", action="store_true", help="incremental runs read new orders only")
    parser.add_argument("--debug", action="store_true")
    parser.add_argument("--retention-days", type=int, default=365)
    parser.add_argument("--high-value-threshold", type=Decimal, default=Decimal("5000.00"))
    parser.add_argument("--loyalty-threshold", type=int, default=5)
    for level, days in (("very-high", 180), ("high", 90), ("medium", 60), ("low", 30)):
        parser.add_argument(f"--churn-days-{level}", type=int, default=days)
    return parser


def params(args: argparse.Namespace) -> RunParams:
    chosen = {"data_date": args.process_date} if args.process_date else {}
    return RunParams(
        process_type=args.process_type,
        debug_mode=args.debug,
        keep_state=args.keep_state,
        run_id=args.run_id,
        retention_days=args.retention_days,
        high_value_threshold=args.high_value_threshold,
        loyalty_threshold=args.loyalty_threshold,
        churn_days_very_high=args.churn_days_very_high,
        churn_days_high=args.churn_days_high,
        churn_days_medium=args.churn_days_medium,
        churn_days_low=args.churn_days_low,
        **chosen,
    )


def source(spark: SparkSession, args: argparse.Namespace) -> Source:
    if args.star_schema:
        return StarSchema(spark, args.star_schema)
    host, _, database = args.sql_server.partition("/")
    properties = {"user": args.user or ""}
    if args.password_file:
        with open(args.password_file) as handle:
            properties["password"] = handle.read().strip()
    pairs = (item.partition("=") for item in args.read_partitions_for)
    reads = {name: TableRead(num_partitions=int(count)) for name, _, count in pairs}
    url = sql_server_url(host, database)
    return JdbcSource(spark, url, properties, num_partitions=args.read_partitions, reads=reads)


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    p = params(args)
    spark = session(f"customer-analytics {p.data_date} {p.process_type}")
    try:
        store = DeltaStore(spark, args.store) if args.delta else TableStore(spark, args.store)
        report = run(store, source(spark, args), p)
    except Exception as error:  # the failed row and the log are already stored
        print(f"run failed: {error}", file=sys.stderr)
        return 1
    print(f"run finished in {report['duration_seconds']:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
