"""Registered queries against their SQL in DuckDB, on the smallest tables; plan checks."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from claimlake.plans import catalog

SQL = catalog.SQL


def _value(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(data + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(map(_value, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(_value(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want


def test_entry(spark):
    assert entry_points.entry(spark).count() >= 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, data):
    assert "WindowGroupLimit" in _plan(catalog.QUERIES["topk_edges"](spark, data))
    assert "PushedFilters: [IsNotNull(query_id)]" in _plan(catalog.QUERIES["topk_edges"](spark, data))
    scan = _plan(catalog.QUERIES["union_splits"](spark, data))
    assert "ReadSchema: struct<dataset:string>" in scan


def test_retrieval_plans(spark, data):
    dense = _plan(catalog.QUERIES["dense_topk"](spark, data))
    assert "MapInArrow" in dense and "CoGroup" not in dense  # the corpus streams past the queries
    bm25 = _plan(catalog.QUERIES["bm25_topk"](spark, data))
    assert "BroadcastHashJoin" in bm25 and "CartesianProduct" not in bm25
    counts = _plan(catalog.QUERIES["kg_token_counts"](spark, data))
    assert counts.count("Exchange hashpartitioning") == 1 and "partial_count" in counts
    near = _plan(catalog.QUERIES["near_vectors"](spark, data))
    assert "NestedLoop" not in near and "CartesianProduct" not in near


def test_summary_holds_no_percentile_buffer(spark, data):
    assert "percentile(" not in _plan(catalog.QUERIES["fusion_summary"](spark, data))
