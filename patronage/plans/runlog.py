"""Step log and run records, kept on the driver and stored as rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from patronage.functions import fixed_values as fx
from patronage.operators.segments import AVERAGE_TYPE
from patronage.params import RunParams
from patronage.sources.store import TableStore

LOG_SCHEMA = (
    "LogID int, StepName string, StartTime timestamp, EndTime timestamp, RowCount bigint, Message string, "
    "ProcessDate date, RunStarted timestamp"
)
SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("ProcessDate", T.DateType()),
        T.StructField("ProcessType", T.StringType()),
        T.StructField("TotalCustomers", T.LongType()),
        T.StructField("ActiveCustomers", T.LongType()),
        T.StructField("NewCustomers", T.LongType()),
        T.StructField("ChurningCustomers", T.LongType()),
        T.StructField("HighValueCustomers", T.LongType()),
        T.StructField("AverageLifetimeValue", AVERAGE_TYPE),
        T.StructField("TotalProcessingTimeMs", T.LongType()),
        T.StructField("ProcessingStatus", T.StringType()),
        T.StructField("ErrorMessage", T.StringType()),
    ]
)


@dataclass
class Step:
    name: str
    started: datetime
    ended: datetime | None = None
    rows: int = 0
    message: str = ""


class RunLog:
    """Numbered steps of one run. A step that raises is logged with -1 rows and the error."""

    def __init__(self, p: RunParams):
        self.p = p
        self.run_id = p.run_id or uuid.uuid4().hex
        self.steps: list[Step] = []
        text = fx.START_MESSAGE.format(day=p.data_date.isoformat(), kind=p.process_type)
        now = datetime.now()
        self.steps.append(Step(fx.STEP_INITIALIZE, now, now, 0, text))

    @contextmanager
    def step(self, name: str, message: str) -> Iterator[Step]:
        entry = Step(name, datetime.now())
        self.steps.append(entry)
        try:
            yield entry
            entry.message = message
        except Exception as error:
            entry.rows, entry.message = -1, f"{fx.ERROR_PREFIX}{error}"
            raise
        finally:
            entry.ended = datetime.now()

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, s.name, s.started, s.ended, s.rows, s.message, self.p.data_date, self.p.started_at)
            for i, s in enumerate(self.steps, start=1)
        ]
        return spark.createDataFrame(rows, LOG_SCHEMA)

    def save(self, store: TableStore) -> None:
        store.replace_run(self.frame(store.spark).coalesce(1), "log", "ProcessLog", self.run_id)

    def elapsed_ms(self) -> int:
        return int((datetime.now() - self.p.started_at).total_seconds() * 1000)


def show(store: TableStore) -> DataFrame:
    """The stored steps in order."""
    return store.read("log", "ProcessLog").orderBy("RunStarted", "LogID")


def summary_row(spark: SparkSession, p: RunParams, counts: dict, elapsed_ms: int) -> DataFrame:
    """The summary of a finished run; ``counts`` is the single row of ``segments.summarize``."""
    values = (
        counts["TotalCustomers"],
        counts["ActiveCustomers"],
        counts["NewCustomers"],
        counts["ChurningCustomers"],
        counts["HighValueCustomers"],
        counts["AverageLifetimeValue"],
    )
    row = (p.data_date, p.process_type, *values, elapsed_ms, fx.STATUS_SUCCESS, None)
    return spark.createDataFrame([row], SUMMARY_SCHEMA)


def failed_row(spark: SparkSession, p: RunParams, error: BaseException, where: str, elapsed_ms: int) -> DataFrame:
    """The record of a failed run: no customers, the time spent, the error and the step it came from."""
    text = f"{error} at step {where}"
    row = (p.data_date, p.process_type, 0, None, None, None, None, None, elapsed_ms, fx.STATUS_FAILED, text)
    return spark.createDataFrame([row], SUMMARY_SCHEMA)
