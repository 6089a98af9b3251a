"""Functions for use from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docspark.functions import diff, url
from docspark.sources.sitemap import Hierarchy

#: SQL functions as expressions over their parameters: they are inlined and stay in generated code.
EXPRESSIONS = {
    "normalize_tag": ("t string", "regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-'), '^-+|-+$', '')"),
    "url_host": ("u string", "regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"),
    "trim_slash": ("u string", "regexp_replace(u, '/+$', '')"),
    "backoff_seconds": ("attempt int, most double", "least(pow(2.0D, attempt - 1), most)"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers url_join, diff_preview, hierarchy (a table function) and EXPRESSIONS in a session."""
    spark.udf.register("url_join", url.join)
    spark.udf.register("diff_preview", diff.preview)
    spark.udtf.register("hierarchy", Hierarchy)
    for name, (parameters, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
    return ["url_join", "diff_preview", "hierarchy", *EXPRESSIONS]
