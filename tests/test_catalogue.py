from __future__ import annotations

import glob
import os

import duckdb
import pytest

from vekspar.plans import catalogue, collections  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    result = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    theirs = sorted((tuple(dict(zip(columns, r, strict=True))[c] for c in order) for r in result.fetchall()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_writes_over_whole_tables(spark, con):
    orders = con.execute("select count(*) from orders").fetchone()[0]
    rows = catalogue.QUERIES["write_update_missing"](spark, DATA).collect()
    assert len(rows) == orders and {r._error for r in rows} == {None, "NOT_FOUND"} and len({r._pk for r in rows}) < orders


def test_batch_of_all_stated_queries(spark, con):
    want = {r[0] for r in con.execute("select vec_id from embeddings where vec_id % 20 = 0").fetchall()}
    assert {r.query_id for r in catalogue.QUERIES["dense_batch"](spark, DATA).collect()} == want
