"""Streaming forms: status events into the latest state, new links into the frontier, a circuit breaker with its state kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark, path: str, schema: str | StructType = EVENTS, files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, `files` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def status_counts(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Events of each type in windows of event time, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


BREAKER_STATE = "mode string, count int, opened double, refused int"
BREAKER_OUT = "key long, mode string, failures int, refused int"


def breaker_update(failures: int, recovery: float):
    """For applyInPandasWithState: events(key, at, seq, ok) of a key in each batch, in order; the state after the batch is put out."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, count, opened, refused = state.get if state.exists else ("closed", 0, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        for at, ok in zip(rows["at"], rows["ok"], strict=True):
            if mode == "open" and at - opened > recovery:
                mode = "half-open"
            if mode == "open":
                refused += 1
            elif ok:
                mode, count = "closed", 0
            else:
                count += 1
                if count >= failures:
                    mode, opened = "open", float(at)
        state.update((mode, count, opened, refused))
        yield pd.DataFrame({"key": [key[0]], "mode": [mode], "failures": [count], "refused": [refused]})

    return update


def breakers(events: DataFrame, failures: int = 10, recovery: float = 300.0) -> DataFrame:
    return events.groupBy("key").applyInPandasWithState(breaker_update(failures, recovery), BREAKER_OUT, BREAKER_STATE, "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, mode: str, checkpoint: str, key: str | None = None) -> DataFrame:
    """Reads what is new since the last time, and gives the sink's table, which lies in path as a snapshot for each batch.

    In complete mode a batch is the table; in update mode its rows take the place of those with their key. A batch that is run again after a
    break writes its snapshot anew, from the one before it. With the same path and checkpoint a later call goes on from there.
    """
    spark = stream.sparkSession
    number = lambda n: f"{path.rstrip('/')}/batch={n}"
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def newest(before: int | None = None) -> str | None:
        found = [s.getPath().getName().removeprefix("batch=") for s in fs.listStatus(at(path))] if fs.exists(at(path)) else []
        whole = [int(n) for n in found if n.isdigit() and fs.exists(at(f"{number(n)}/_SUCCESS"))]
        whole = [n for n in whole if before is None or n < before]
        return number(max(whole)) if whole else None

    def put(batch: DataFrame, n: int) -> None:
        old = newest(n)
        if mode == "update" and old:
            kept = spark.read.schema(stream.schema).parquet(old)
            batch = kept.join(batch.select(key).distinct(), key, "left_anti").select(batch.columns).union(batch)
        batch.write.mode("overwrite").parquet(number(n))

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = newest()
    return spark.read.schema(stream.schema).parquet(last) if last else spark.createDataFrame([], stream.schema)
