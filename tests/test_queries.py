"""Every query without a data folder of its own runs on the smallest tables; a part of them against their SQL."""

import glob
import os

import pytest

import __spark_entry__
from docspark.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    if name not in SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(n) for n in names]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr(tuple(tidy(r[n]) for n in names)) for r in got.collect()) == sorted(repr(tuple(tidy(r[i]) for i in order)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
