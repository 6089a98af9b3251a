"""Arrow functions over whole texts work in parts of bounded size, whatever the size of a partition."""

import pyarrow as pa

from docspark.operators import batches, extract, lint

TEXT = "<main><h1>T</h1><p>" + "x" * 1000 + "</p></main>"


def test_parts():
    texts = ["a" * 10, None, "b" * 95, "", "c" * 5, "d" * 300, "e"]
    whole = pa.RecordBatch.from_pydict({"t": texts})
    got = [p.column("t").to_pylist() for p in batches.parts([whole, whole.slice(0, 0), whole], "t", 100)]
    assert got == [["a" * 10, None], ["b" * 95, "", "c" * 5], ["d" * 300], ["e"]] * 2


def test_pages_in_parts():
    n = 5000
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["https://h/x"] * n, "html": [TEXT] * n})
    made = list(extract._page_batches("__STATE__")(iter([batch])))
    assert max(b.num_rows for b in made) * len(TEXT) <= batches.PART_BYTES
    assert [i for b in made for i in b.column("page_id").to_pylist()] == list(range(n))
    assert all(t == "T" for b in made for t in b.column("title").to_pylist())


def test_rows_sent(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for had, left in (("10000", "1000"), ("0", "1000"), ("7", "7")):
            spark.conf.set(key, had)
            extract.pages(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"))
            assert spark.conf.get(key) == left
    finally:
        spark.conf.set(key, before)


def test_lint_in_parts():
    n = 5000
    text = "# a\nb  \n" * 100
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "_text": [text] * n})
    made = list(lint._lint_batches("doc_id", (lint.trailing_whitespace,), True)(iter([batch])))
    assert max(b.num_rows for b in made) * len(text) <= batches.PART_BYTES
    assert [i for b in made for i in b.column("doc_id").to_pylist()] == list(range(n))
    assert all(len(x) == 100 for b in made for x in b.column("issues").to_pylist())
