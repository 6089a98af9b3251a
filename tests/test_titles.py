"""Titles read references as the SQL of q_title does: those that a semicolon ends."""

import duckdb
import pytest

import __spark_entry__
from docspark.functions import dom

HEADS = ["a &amp; b", "a&amp;&amp;&amp", "x &lt y &#x27 z", " &quot;q&quot; &lt;b&gt; &#x27;", "Q&A &copy", "&", "&am", "&amp;amp"]


@pytest.mark.parametrize("name", ["q_title", "q_page_title"])
def test_titles(spark, tmp_path, name):
    pages = [(k, f"<html><title>t</title><h1>{h}</h1><p>&lt</p></html>") for k, h in enumerate(HEADS)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.title for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(f"select page_id, title from ({__spark_entry__.oracle_sql()[name]})").fetchall())


def test_html_reads_open_references():
    assert dom.parse("<h1>a&amp</h1>").text() == "a&"
    assert dom.parse("<h1>a&amp &amp; &#38;</h1>", True).text() == "a&amp & &"
