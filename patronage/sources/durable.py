"""Cutting lineage so that a lost executor cannot force a long recompute."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; in local mode a folder of our own when none is named."""
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="patronage-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The frame, computed once and read back from the shared folder."""
    folder = shared_dir(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def scratch_path(spark: SparkSession) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
