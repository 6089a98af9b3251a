"""Pages that share a URL: each counts once in its own place, as in the SQL."""

import duckdb
import pytest

import __spark_entry__
from docspark.plans import flows

#: Page 10 and 20 share the URL and the sitemap, 11 has it in another map, 13 in another map of the same rank.
URLS = {k: f"https://m.example.net/p{k}" for k in range(40)} | dict.fromkeys((10, 11, 13, 20, 40), "https://m.example.net/same")


@pytest.mark.parametrize("name", ["q_sitemap_first_source", "q_sitemap_parse"])
def test_sitemaps(spark, tmp_path, name):
    spark.createDataFrame(list(URLS.items()), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_files(spark, tmp_path):
    """Two pages of one URL and text: a file each by the query, one file in a vault."""
    html = "<article><h1>Same</h1><p>text</p></article>"
    pages = spark.createDataFrame([(1, "https://m.h/a", html), (2, "https://m.h/a", html), (3, "https://m.h/b", html)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert __spark_entry__.queries()["q_flow_files"](spark, str(tmp_path)).first().asDict() == {"pages": 3, "files": 3}
    names = {r.page_id: r.file_path for r in flows.markdown_pages(pages).collect()}
    assert names[1] == names[2] != names[3]
