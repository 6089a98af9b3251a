"""Crawl state as tables: events fold into the latest state, inserts never overwrite, selections keep the frontier's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a page.
STATUSES = ("pending", "in_progress", "completed", "failed", "skipped")


def fold(pages: DataFrame, events: DataFrame) -> DataFrame:
    """pages(url, status, retry_count, updated_at, completed_at, file_path, error_message) after events(url, seq, ts, status,
    file_path, error_message). Events of unknown pages do nothing; empty values never clear a column."""
    truthy = lambda c: F.nullif(F.col(c), F.lit(""))
    latest = lambda c: F.max_by(truthy(c), F.when(truthy(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
    folded = events.groupBy("url").agg(
        F.max_by("status", "seq").alias("_status"), F.max_by("ts", "seq").alias("_ts"), F.count_if(F.col("status") == "failed").cast("int").alias("_failures"),
        F.max_by("ts", F.when(F.col("status") == "completed", F.col("seq"))).alias("_done"), latest("file_path"), latest("error_message"),
    )
    out = pages.join(folded, "url", "left")
    changes = {
        "status": F.coalesce("_status", "status"), "updated_at": F.coalesce("_ts", "updated_at"), "completed_at": F.coalesce("_done", "completed_at"),
        "retry_count": F.col("retry_count") + F.coalesce("_failures", F.lit(0)), "file_path": F.coalesce("_file_path", "file_path"), "error_message": F.coalesce("_error_message", "error_message"),
    }
    return out.withColumns(changes).select(pages.columns)


def insert_new(known: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of new whose key is not known, the first of each key by order."""
    firsts = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), F.col(order)).alias("r")).select("r.*")
    return firsts.join(known.select(key), key, "left_anti")


def page_statistics(pages: DataFrame) -> DataFrame:
    """total, completed, failed, pending, in_progress; sums over no rows are null. Skipped pages count in the total only."""
    return pages.agg(F.count("*").alias("total"), *(F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s) for s in ("completed", "failed", "pending", "in_progress")))


def image_statistics(images: DataFrame) -> DataFrame:
    return images.agg(F.count("*").alias("total"), F.sum(F.when(F.col("downloaded"), 1).otherwise(0)).alias("downloaded"), F.sum(F.when(F.col("error_message").isNotNull(), 1).otherwise(0)).alias("failed"))


def run_statistics(pages: DataFrame, images: DataFrame) -> DataFrame:
    """One row: both statistics side by side."""
    p, i = page_statistics(pages), image_statistics(images)
    return p.select("total", "completed", "failed").toDF("pages_total", "pages_completed", "pages_failed").join(i.select("total", "downloaded").toDF("images_total", "images_downloaded"), F.lit(True))


def pending(pages: DataFrame, limit: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Pending and failed pages in the frontier's order. A limit of 0 is none."""
    rows = pages.where(F.col("status").isin("pending", "failed"))
    rows = rows if max_depth is None else rows.where(F.col("crawl_depth") <= max_depth)
    rows = rows.orderBy("crawl_depth", "retry_count", "created_at", "url")
    return rows.limit(limit) if limit else rows


def failed_for_retry(pages: DataFrame, max_retries: int = 3) -> DataFrame:
    return pages.where((F.col("status") == "failed") & (F.col("retry_count") < max_retries)).orderBy("retry_count", "updated_at", "url")


def retry_candidates(pages: DataFrame, now: Column, max_retries: int = 3, delay_minutes: int = 5) -> DataFrame:
    """Failed pages with retries left whose last update is delay_minutes old."""
    return failed_for_retry(pages, max_retries).where(F.timestamp_add("MINUTE", F.lit(delay_minutes), F.col("updated_at")) <= now)


def permanently_failed(pages: DataFrame, max_retries: int = 3) -> DataFrame:
    return pages.where((F.col("status") == "failed") & (F.col("retry_count") >= max_retries)).orderBy(F.desc("updated_at"), "url")


def recent_failures(pages: DataFrame, most: int = 10) -> DataFrame:
    return pages.where("status = 'failed'").orderBy(F.desc("updated_at"), "url").limit(most)


def pending_images(images: DataFrame) -> DataFrame:
    return images.where("not downloaded and error_message is null")


def reset_in_progress(pages: DataFrame) -> DataFrame:
    return pages.withColumn("status", F.when(F.col("status") == "in_progress", F.lit("pending")).otherwise(F.col("status")))


def reset_for_retry(pages: DataFrame, url: Column) -> DataFrame:
    """One page becomes pending and loses its error."""
    own = F.col("url") == url
    return pages.withColumns({"status": F.when(own, F.lit("pending")).otherwise(F.col("status")), "error_message": F.when(~own, F.col("error_message"))})


def retry_plan(pages: DataFrame, max_retries: int = 3, most: int = 30) -> DataFrame:
    """Failed pages with the seconds to wait: powers of two up to `most`."""
    return failed_for_retry(pages, max_retries).select("url", "retry_count", F.least(F.lit(float(most)), F.pow(F.lit(2.0), F.col("retry_count"))).alias("wait"))


def discovered(pages: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """New pages below known ones: links(parent_url, url, ord) at the parent's depth and one, the first link of each URL."""
    deeper = links.join(pages.select(F.col("url").alias("parent_url"), F.col("crawl_depth").alias("_d")), "parent_url").where(F.col("_d") < max_depth)
    rows = deeper.select("url", F.lit("pending").alias("status"), (F.col("_d") + 1).alias("crawl_depth"), "parent_url", "ord")
    return insert_new(pages, rows, "url", "ord")


def http_action(status: Column, retry_after: Column) -> Column:
    """struct(action, wait) of a response: 429 waits as told (60 s otherwise), 503 waits 30 s, other errors give up."""
    return F.struct(
        F.when(status.isin(429, 503), F.lit("retry")).when(status >= 400, F.lit("empty")).otherwise(F.lit("parse")).alias("action"),
        F.when(status == 429, F.coalesce(retry_after, F.lit(60))).when(status == 503, F.lit(30)).otherwise(F.lit(0)).alias("wait"),
    )


def fold_images(images: DataFrame, events: DataFrame) -> DataFrame:
    """images(url, page_url, local_path, downloaded, error_message) after events(url, seq, local_path, downloaded, error_message)."""
    folded = events.groupBy("url").agg(F.max_by(F.struct("downloaded", "local_path", "error_message"), "seq").alias("_e"))
    changes = {c: F.when(F.col("_e").isNotNull(), F.col(f"_e.{c}")).otherwise(F.col(c)) for c in ("downloaded", "local_path", "error_message")}
    return images.join(folded, "url", "left").withColumns(changes).select(images.columns)


def orphans(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Images whose page is not known."""
    return images.join(pages.select(F.col("url").alias("page_url")), "page_url", "left_anti")


def finished_run(runs: DataFrame, run_id: int, statistics: DataFrame, now: Column) -> DataFrame:
    """runs with one run's figures and its end set."""
    names = ("pages_total", "pages_completed", "pages_failed", "images_total", "images_downloaded")
    one = statistics.select(*(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(f"_{c}") for c in names))
    own = F.col("id") == run_id
    return runs.join(F.broadcast(one), F.lit(True)).withColumns({c: F.when(own, F.col(f"_{c}")).otherwise(F.col(c)) for c in names} | {"completed_at": F.when(own, now).otherwise(F.col("completed_at"))}).select(runs.columns)


def statistics_table(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Rows (part, name, n) of both statistics, to be shown one below the other."""
    long = lambda rows, part: rows.unpivot([], rows.columns, "name", "n").select(F.lit(part).alias("part"), "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return long(page_statistics(pages), "pages").union(long(image_statistics(images), "images"))


def mapped(pages: DataFrame) -> DataFrame:
    """url, title, file_path of pages that have a file: what links are resolved with."""
    return pages.where(F.col("file_path").isNotNull()).select("url", "title", "file_path")


def discovered_urls(urls: DataFrame) -> DataFrame:
    """Each URL once, sorted."""
    return urls.select("url").distinct().orderBy("url")
