"""Cutting lineage by checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="docspark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only local masters, as in tests, may go without that setting: they have one folder for as long as
    the program runs, as a running session's setting can't be changed."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(rows: DataFrame) -> DataFrame:
    """rows of a table just read, dealt over the session's cores if its files give fewer partitions than these, so that work on whole texts
    isn't one task; a table of more files stays as it is, without a shuffle. Not for rows that come from a shuffle: it would run here."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
