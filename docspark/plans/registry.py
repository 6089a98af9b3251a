"""Named queries with their SQL."""

from __future__ import annotations

from docspark.operators.lineage import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its own name, with the DuckDB SQL for the same rows if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir: str, name: str):
    """The same for work on whole texts or HTML: a table of fewer partitions than cores is dealt over these."""
    return spread(table(spark, sf_dir, name))
