"""Schemas of the state tables, and their growth by new columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = "url string, status string, title string, content_hash string, file_path string, error_message string, retry_count int, crawl_depth int, parent_url string, created_at timestamp, updated_at timestamp, completed_at timestamp"
IMAGES = "url string, page_url string, local_path string, downloaded boolean, error_message string, created_at timestamp"
RUNS = "id bigint, started_at timestamp, completed_at timestamp, pages_total bigint, pages_completed bigint, pages_failed bigint, images_total bigint, images_downloaded bigint"
#: What columns hold that rows of older tables lack.
DEFAULTS = {"status": "pending", "retry_count": 0, "crawl_depth": 0, "downloaded": False}


def grown(rows: DataFrame, schema: str) -> DataFrame:
    """rows with all columns of the schema, in its order and types; missing ones have their default or null, others go."""
    empty = rows.sparkSession.createDataFrame([], schema)
    missing = [f.name for f in empty.schema if f.name not in rows.columns]
    out = rows.withColumns({c: F.lit(DEFAULTS.get(c)) for c in missing})
    return out.select(*(F.col(f.name).cast(f.dataType) for f in empty.schema))
