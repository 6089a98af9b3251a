"""Stateful controls as folds over ordered events of a key: failure runs, circuit breaker, token bucket, back-off.

The folds gather one key's events in one row; for keys that may hold a large share of all events, failure_runs is a window, and the
streaming forms keep their state between batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backoff(attempt: Column, initial: float = 1.0, base: float = 2.0, most: float = 60.0, jitter_seed: int | None = None) -> Column:
    wait = F.least(F.lit(initial) * F.pow(F.lit(base), attempt - 1), F.lit(most))
    return wait if jitter_seed is None else wait * (F.lit(0.5) + F.rand(jitter_seed))


def failure_runs(events: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """Adds the number of failures in a row up to each event."""
    w = Window.partitionBy(key).orderBy(order)
    island = events.withColumn("_f", failed).withColumn("_island", F.sum(F.when(~F.col("_f"), 1).otherwise(0)).over(w))
    return island.withColumn("run", F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(Window.partitionBy(key, "_island").orderBy(order))).drop("_f", "_island")


def breaker_step(state: Column, ok: Column, at: Column, failures: int, recovery: float) -> Column:
    """state(mode, count, opened, allowed): an event that comes while the breaker is open is refused until recovery seconds have
    passed, then one attempt is let through; a success closes, a failure from the limit on opens."""
    waited = at - state["opened"] > recovery
    mode = F.when((state["mode"] == "open") & waited, F.lit("half-open")).otherwise(state["mode"])
    refused = mode == "open"
    count = F.when(refused, state["count"]).when(ok, F.lit(0)).otherwise(state["count"] + 1)
    opens = ~refused & ~ok & (count >= failures)
    return F.struct(
        F.when(refused, mode).when(ok, F.lit("closed")).when(opens, F.lit("open")).otherwise(mode).alias("mode"), count.alias("count"),
        F.when(opens, at).otherwise(state["opened"]).alias("opened"), (state["refused"] + F.when(refused, 1).otherwise(0)).alias("refused"),
    )


def circuit_breaker(events: DataFrame, key: str, failures: int = 10, recovery: float = 300.0) -> DataFrame:
    """events(key, at double seconds, seq, ok) -> key, mode, failures, refused after all events in order."""
    start = F.struct(F.lit("closed").alias("mode"), F.lit(0).alias("count"), F.lit(0.0).alias("opened"), F.lit(0).alias("refused"))
    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "seq", "ok"))).alias("e"))
    end = F.aggregate("e", start, lambda s, e: breaker_step(s, e["ok"], e["at"], failures, recovery))
    return ordered.select(key, end.alias("s")).select(key, "s.mode", F.col("s.count").alias("failures"), "s.refused")


def token_bucket(events: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """events(key, at, seq), each taking one token -> key, waits: how many had to wait, and how long in all."""
    start = F.struct(F.lit(float(burst)).alias("tokens"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("waited"))

    def take(s, e):
        # One that waited is served when its token has come: the bucket is empty at that time.
        now = F.greatest(e["at"], F.coalesce(s["last"], e["at"]))
        tokens = F.least(F.lit(float(burst)), s["tokens"] + (now - F.coalesce(s["last"], now)) * rate)
        wait = F.when(tokens >= 1, F.lit(0.0)).otherwise((1 - tokens) / rate)
        return F.struct(F.when(tokens >= 1, tokens - 1).otherwise(F.lit(0.0)).alias("tokens"), (now + wait).alias("last"), (s["n"] + F.when(wait > 0, 1).otherwise(0)).alias("n"), (s["waited"] + wait + now - e["at"]).alias("waited"))

    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("e"))
    return ordered.select(key, F.aggregate("e", start, take).alias("s")).select(key, F.col("s.n").alias("waits"), F.round("s.waited", 6).alias("waited"))


def until_stopped(events: DataFrame, key: str, order: str, failed: Column, most: int = 20) -> DataFrame:
    """The events of each key up to the one that makes `most` failures in a row; all of a key that never comes so far."""
    runs = failure_runs(events, key, order, failed)
    stops = runs.where(F.col("run") >= most).groupBy(key).agg(F.min(order).alias("_stop"))
    return runs.join(stops, key, "left").where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop", "run")


def within_limits(rows: DataFrame, at: str, started: Column, minutes: int, pages: int, depth: int) -> DataFrame:
    """What a run takes before a limit ends it: rows of up to `depth`, within `minutes` of its start, the first `pages` of them."""
    rows = rows.where((F.col("crawl_depth") <= depth) & (F.timestamp_diff("SECOND", started, F.col(at)) < 60 * minutes))
    return rows.orderBy(at, "url").limit(pages)


def recent(events: DataFrame, key: str, order: str, kept: int = 100, told: int = 10) -> DataFrame:
    """A ring of each key's last `kept` events, with `age` from 1 for the latest, and whether it is among the last `told`."""
    ranked = events.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("age") <= kept)
    return ranked.withColumn("told", F.col("age") <= told)


def health(probes: DataFrame, workers: Column) -> DataFrame:
    """probes(disk_free_gb, disk_used, memory_free_gb, memory_used, cpu_used) with disk_ok, memory_ok, cpu_ok, and the workers to go on
    with: half of them, one at least, where memory is short."""
    out = probes.withColumns({"disk_ok": (F.col("disk_free_gb") > 1) & (F.col("disk_used") < 90), "memory_ok": (F.col("memory_free_gb") > 0.5) & (F.col("memory_used") < 85), "cpu_ok": F.col("cpu_used") < 90})
    return out.withColumn("workers", F.when(F.col("memory_ok"), workers).otherwise(F.greatest(F.lit(1), F.floor(workers / 2).cast("int"))))


def roll_up(checked: DataFrame) -> DataFrame:
    """One row: probes, whether all checks of all hold, and whether any check of any fails. Null without probes."""
    every = F.col("disk_ok") & F.col("memory_ok") & F.col("cpu_ok")
    return checked.agg(F.count("*").alias("probes"), F.every(every).alias("healthy"), F.some(~every).alias("any_problem"), F.count_if(every).alias("well"))
