"""Queries over events as a crawl's history: states, selections, controls; and their streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docspark.operators import control, state
from docspark.operators.lineage import shared_folder
from docspark.plans.registry import query, table
from docspark.streaming import frontier

_STATUS = {"signup": "pending", "view": "in_progress", "click": "completed", "error": "failed", "purchase": "skipped"}
_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())
_EV = f"""ev AS (SELECT 'https://h/' || user_id AS url, user_id, event_id AS seq, ts, CASE event_type {_CASE} END AS status,
  CASE WHEN event_type = 'click' THEN 'docs/' || (event_id % 7) || '.md' END AS file_path, CASE WHEN event_type = 'error' THEN props END AS error_message FROM events),
st AS (SELECT url, arg_max(status, seq) AS status, CAST(count(*) FILTER (WHERE status = 'failed') AS INT) AS retry_count, CAST(any_value(user_id % 4) AS INT) AS crawl_depth, min(ts) AS created_at,
  arg_max(ts, seq) AS updated_at, arg_max(ts, seq) FILTER (WHERE status = 'completed') AS completed_at, arg_max(file_path, seq) FILTER (WHERE file_path IS NOT NULL) AS file_path,
  arg_max(error_message, seq) FILTER (WHERE error_message IS NOT NULL) AS error_message FROM ev GROUP BY url)"""


def _events(spark, sf_dir):
    kinds = F.create_map(*(F.lit(x) for kv in _STATUS.items() for x in kv))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://h/"), F.col("user_id").cast("string")).alias("url"), "user_id", F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kinds[F.col("event_type")].alias("status"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("docs/"), (F.col("event_id") % 7).cast("string"), F.lit(".md"))).alias("file_path"), F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
    )


def _pages(spark, sf_dir):
    events = _events(spark, sf_dir)
    new = events.groupBy("url").agg(F.min("ts").alias("created_at"), (F.first("user_id") % 4).cast("int").alias("crawl_depth"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    start = new.select("url", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), "crawl_depth", "created_at", F.col("created_at").alias("updated_at"), none("completed_at", "timestamp"), none("file_path", "string"), none("error_message", "string"))
    return state.fold(start, events)


_OUT = "url, status, retry_count, crawl_depth, epoch_us(updated_at) AS updated_us, epoch_us(completed_at) AS completed_us, file_path, error_message"


def _told(rows):
    return rows.select("url", "status", "retry_count", "crawl_depth", F.unix_micros("updated_at").alias("updated_us"), F.unix_micros("completed_at").alias("completed_us"), "file_path", "error_message")


@query(f"WITH {_EV} SELECT {_OUT} FROM st")
def q_status_fold(spark, sf_dir):
    return _told(_pages(spark, sf_dir))


_STATS = ", ".join(f"CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}" for s in ("completed", "failed", "pending", "in_progress"))


@query(f"WITH {_EV} SELECT count(*) AS total, {_STATS} FROM st")
def q_stats_pages(spark, sf_dir):
    return state.page_statistics(_pages(spark, sf_dir))


def _images(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("url"), (F.col("quality") == 1).alias("downloaded"), F.when(F.col("toxic") == 1, F.lit("bad")).alias("error_message"))


@query("SELECT count(*) AS total, CAST(sum(quality) AS BIGINT) AS downloaded, CAST(sum(toxic) AS BIGINT) AS failed FROM labels")
def q_stats_images(spark, sf_dir):
    return state.image_statistics(_images(spark, sf_dir))


@query(f"""WITH {_EV} SELECT p.*, i.* FROM (SELECT count(*) AS pages_total, CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS pages_completed, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS pages_failed FROM st) p,
  (SELECT count(*) AS images_total, CAST(sum(quality) AS BIGINT) AS images_downloaded FROM labels) i""")
def q_run_stats(spark, sf_dir):
    return state.run_statistics(_pages(spark, sf_dir), _images(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS url FROM labels WHERE quality <> 1 AND toxic <> 1")
def q_pending_images(spark, sf_dir):
    return state.pending_images(_images(spark, sf_dir)).select("url")


@query(f"WITH {_EV} SELECT url, status, crawl_depth FROM st WHERE status IN ('pending', 'failed') AND crawl_depth <= 2 ORDER BY crawl_depth, retry_count, created_at, url LIMIT 20")
def q_pending(spark, sf_dir):
    return state.pending(_pages(spark, sf_dir), 20, 2).select("url", "status", "crawl_depth")


@query(f"WITH {_EV} SELECT url, retry_count FROM st WHERE status = 'failed' AND retry_count < 15")
def q_failed_for_retry(spark, sf_dir):
    return state.failed_for_retry(_pages(spark, sf_dir), 15).select("url", "retry_count")


@query(f"WITH {_EV} SELECT url FROM st WHERE status = 'failed' AND retry_count < 1000 AND updated_at + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev)")
def q_retry_candidates(spark, sf_dir):
    now = _events(spark, sf_dir).agg((F.max("ts") - F.expr("interval 1 hour")).alias("now"))
    return state.retry_candidates(_pages(spark, sf_dir).join(F.broadcast(now), F.lit(True)), F.col("now"), 1000).select("url")


@query(f"WITH {_EV} SELECT url, retry_count FROM st WHERE status = 'failed' AND retry_count >= 12")
def q_perm_failed(spark, sf_dir):
    return state.permanently_failed(_pages(spark, sf_dir), 12).select("url", "retry_count")


@query(f"WITH {_EV} SELECT url, error_message FROM st WHERE status = 'failed' ORDER BY updated_at DESC, url LIMIT 10")
def q_failed_recent_top10(spark, sf_dir):
    return state.recent_failures(_pages(spark, sf_dir)).select("url", "error_message")


@query(f"WITH {_EV} SELECT url, CASE WHEN status = 'in_progress' THEN 'pending' ELSE status END AS status FROM st")
def q_reset_in_progress(spark, sf_dir):
    return state.reset_in_progress(_pages(spark, sf_dir)).select("url", "status")


@query(f"WITH {_EV} SELECT url, CASE WHEN url = 'https://h/8' THEN 'pending' ELSE status END AS status, CASE WHEN url = 'https://h/8' THEN NULL ELSE error_message END AS error_message FROM st")
def q_reset_for_retry(spark, sf_dir):
    return state.reset_for_retry(_pages(spark, sf_dir), F.lit("https://h/8")).select("url", "status", "error_message")


@query("""
WITH n AS (SELECT 'https://h/' || (user_id * 2) AS url, min(event_id) AS ord FROM events GROUP BY user_id), k AS (SELECT DISTINCT 'https://h/' || user_id AS url FROM events)
SELECT url, ord FROM n WHERE url NOT IN (SELECT url FROM k)
""")
def q_insert_ignore(spark, sf_dir):
    new = table(spark, sf_dir, "events").select(F.concat(F.lit("https://h/"), (F.col("user_id") * 2).cast("string")).alias("url"), F.col("event_id").alias("ord"))
    return state.insert_new(_events(spark, sf_dir).select("url").distinct(), new, "url", "ord")


@query(f"""
WITH {_EV}, l AS (SELECT url AS parent_url, 'https://n/' || (seq % 500) AS url, seq AS ord FROM ev), j AS (SELECT l.*, crawl_depth + 1 AS d FROM l JOIN st ON st.url = l.parent_url WHERE crawl_depth < 3)
SELECT url, 'pending' AS status, CAST(arg_min(d, ord) AS INT) AS crawl_depth, arg_min(parent_url, ord) AS parent_url, min(ord) AS ord FROM j GROUP BY url
""")
def q_frontier_new(spark, sf_dir):
    links = _events(spark, sf_dir).select(F.col("url").alias("parent_url"), F.concat(F.lit("https://n/"), (F.col("seq") % 500).cast("string")).alias("url"), F.col("seq").alias("ord"))
    return state.discovered(_pages(spark, sf_dir), links, 3)


@query(f"WITH {_EV} SELECT url, retry_count, least(30.0, pow(2, retry_count)) AS wait FROM st WHERE status = 'failed' AND retry_count < 1000")
def q_retry_plan(spark, sf_dir):
    return state.retry_plan(_pages(spark, sf_dir), 1000)


@query("""
WITH c AS (SELECT event_id, list_extract([200, 404, 429, 503, 429], CAST(event_id % 5 + 1 AS INT)) AS s, CASE WHEN event_id % 5 = 4 THEN 7 END AS r FROM events)
SELECT event_id, CASE WHEN s IN (429, 503) THEN 'retry' WHEN s >= 400 THEN 'empty' ELSE 'parse' END AS action, CAST(CASE s WHEN 429 THEN coalesce(r, 60) WHEN 503 THEN 30 ELSE 0 END AS INT) AS wait FROM c
""")
def q_http_actions(spark, sf_dir):
    k = (F.col("event_id") % 5 + 1).cast("int")
    status = F.element_at(F.array(*map(F.lit, (200, 404, 429, 503, 429))), k)
    rows = table(spark, sf_dir, "events").select("event_id", state.http_action(status, F.when(k == 5, F.lit(7))).alias("a"))
    return rows.select("event_id", "a.action", "a.wait")


# ---- controls ----


@query("""
WITH g AS (SELECT *, event_type = 'error' AS f, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events)
SELECT event_id, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS run FROM g
""")
def q_consecutive_failures(spark, sf_dir):
    return control.failure_runs(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "run")


def _timed(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))


_BREAKER = """
WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t0, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
m AS (SELECT DISTINCT key, 0 AS k, 'closed' AS mode, 0 AS count, CAST(0 AS DOUBLE) AS opened, 0 AS refused FROM e
  UNION ALL SELECT key, k, CASE WHEN now = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN count + 1 >= 2 THEN 'open' ELSE now END, CASE WHEN now = 'open' THEN count WHEN ok THEN 0 ELSE count + 1 END,
    CASE WHEN now <> 'open' AND NOT ok AND count + 1 >= 2 THEN t0 ELSE opened END, refused + CASE WHEN now = 'open' THEN 1 ELSE 0 END
  FROM (SELECT e.key, e.k, e.t0, e.ok, m.count, m.opened, m.refused, CASE WHEN m.mode = 'open' AND e.t0 - m.opened > 7200 THEN 'half-open' ELSE m.mode END AS now FROM m JOIN e ON e.key = m.key AND e.k = m.k + 1) x)
SELECT key, arg_max(mode, k) AS mode, CAST(arg_max(count, k) AS INT) AS failures, CAST(arg_max(refused, k) AS INT) AS refused FROM m GROUP BY key
"""


@query(_BREAKER)
def q_circuit_breaker(spark, sf_dir):
    return control.circuit_breaker(_timed(spark, sf_dir), "key", 2, 7200.0)


@query("""
WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
m AS (SELECT DISTINCT key, 0 AS k, CAST(2 AS DOUBLE) AS tokens, CAST(NULL AS DOUBLE) AS last, 0 AS n, CAST(0 AS DOUBLE) AS waited FROM e
  UNION ALL SELECT key, k, CASE WHEN tok >= 1 THEN tok - 1 ELSE 0 END, now + CASE WHEN tok >= 1 THEN 0 ELSE (1 - tok) / rate END, n + CASE WHEN tok >= 1 THEN 0 ELSE 1 END,
    waited + CASE WHEN tok >= 1 THEN 0 ELSE (1 - tok) / rate END + now - t0
  FROM (SELECT *, least(2.0, tokens + (now - coalesce(last, now)) * rate) AS tok FROM (SELECT e.key, e.k, e.t0, m.tokens, m.last, m.n, m.waited, CAST(1 AS DOUBLE) / 7200 AS rate, greatest(e.t0, coalesce(m.last, e.t0)) AS now FROM m JOIN e ON e.key = m.key AND e.k = m.k + 1)))
SELECT key, CAST(arg_max(n, k) AS INT) AS waits, round(arg_max(waited, k), 6) AS waited FROM m GROUP BY key
""")
def q_token_bucket(spark, sf_dir):
    return control.token_bucket(_timed(spark, sf_dir), "key", 1 / 7200, 2)


@query("SELECT event_id, least(pow(2, event_id % 12), 60.0) AS wait FROM events")
def q_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", control.backoff(F.col("event_id") % 12 + 1).alias("wait"))


# ---- streams: the same results from a stream over the files ----


def _stream(spark, sf_dir):
    """The events table as a stream of files; a single file is given a folder by its name's pattern."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _run(spark, stream, name, mode, key=None):
    root = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    return frontier.run_once(stream, f"{root}/table", mode, f"{root}/checkpoint", key)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q_stream_counts(spark, sf_dir):
    events = _stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return _run(spark, events, "counts", "complete")


@query("""SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def q_stream_windows(spark, sf_dir):
    events = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _run(spark, frontier.status_counts(events), "windows", "complete")
    return rows.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(_BREAKER)
def q_stream_breaker(spark, sf_dir):
    events = _stream(spark, sf_dir).select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return _run(spark, frontier.breakers(events, 2, 7200.0), "breaker", "update", "key")
