import os

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    """Each stage keeps what its own plain form keeps, and the columns of documents."""
    from tests.llm.test_near_dedup import plain as near
    from tests.llm.test_texts import plain as leaks

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        kept.append(after)
        assert after <= set(before)
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            known = [i for i in before if i in labels]
            assert sum((i in after) == bool(labels[i].quality) for i in known) >= 0.9 * len(known)
        if k == 1:
            known = [i for i in before if i in labels]
            assert sum((i in after) != bool(labels[i].toxic) for i in known) >= 0.9 * len(known)
        if k == 2:
            assert after == {i for i, (_, c) in near(list(before.items())).items() if i == c}
        if k == 3:
            assert after == set(before) - {d for d, _ in leaks(list(before.items()), items)}
        if k == 4:
            assert after == set(before)
    assert corpus_pipeline.run(spark, SF).count() == len(kept[-1])


def test_registration():
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found if n.startswith("op")) == list(range(1, 11)) and "pipeline" in found
    assert set(queries.oracle_sql()) <= set(found) and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """Every stage and the whole pipeline over odd rows, odd names, and tables without rows."""
    odd = odd_docs.withColumn("my col", F.lit(1)).withColumn("gone_doc", F.lit(2)).withColumn("stats", F.lit(3)).withColumn("a-b", F.lit("x"))
    tables = {
        "labels": spark.createDataFrame([(1, 1, 0), (4, 1, 0), (8, 0, 1), (None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, odd_docs.where("doc_id = 4").first().text), (2, None), (None, "")], "item_id long, text string"),
    }
    for name, docs, rows in (("odd", odd, tables), ("none", no_docs, {k: t.limit(0) for k, t in tables.items()}), ("unlabelled", odd, {k: t.limit(0) for k, t in tables.items()})):
        folder = f"{tmp_path}/{name}"
        for table, df in {"documents": docs, **rows}.items():
            df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
        got = corpus_pipeline.run(spark, folder).collect()
        ids = [r.doc_id for r in got]
        assert len(got) <= docs.count() and (4 not in ids or name != "odd")
        if name == "unlabelled":
            assert sorted(i or 0 for i in ids) == [0, 1, 4, 5, 6, 7, 8, 10, 11, 11, 12]
