"""Queries over whole tables: no bound on ids or depth, no user left out, no limit where nothing asks for one."""

import re

import __spark_entry__
from docspark.operators import links
from docspark.plans import flows


def test_reachable_until_nothing_is_new(spark):
    edges = spark.createDataFrame([(f"u{k}", f"u{k + 1}") for k in range(9)] + [("u9", "u0"), ("x", "y")], "parent_url string, url string")
    starts = spark.createDataFrame([("u0",)], "url string")
    assert {r.url: r.depth for r in links.reachable(starts, edges).collect()} == {f"u{k}": k for k in range(10)}
    assert links.reachable(starts, edges, 3).count() == 4


def test_bfs_over_all_pages(spark, tmp_path):
    spark.range(300).withColumnRenamed("id", "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.url: r.depth for r in __spark_entry__.queries()["q_bfs_reachable"](spark, str(tmp_path)).collect()}
    assert got == {f"https://s/{n}": n.bit_length() - 1 for n in range(1, 300)}


def test_images_of_all_users(spark, tmp_path):
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    events = [(1, 1, "click", None), (2, 1, "error", "e1"), (3, 2, "error", "e2"), (4, 2, "click", None), (5, 3, "error", "e3")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.url: (r.downloaded, r.error_message) for r in __spark_entry__.queries()["q_images_fold"](spark, str(tmp_path)).collect()}
    assert got == {"1": (False, "e1"), "2": (True, None), "3": (False, "e3"), "4": (False, None)}


def test_discovery_without_limit(spark, tmp_path):
    pages = [(k, f"https://m.example.net/p{k}") for k in range(20)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = __spark_entry__.queries()["q_flow_discover"](spark, str(tmp_path))
    assert not re.search("GlobalLimit [1-9]", found._jdf.queryExecution().toString()) and found.count() == 10
    assert [r.url for r in flows._discovered(spark, str(tmp_path), 3).collect()] == [r.url for r in found.collect()][:3]
