"""Registered llm queries on the smallest tables: against SQL where there is some, else that they run with stable columns."""

import glob
import os

import duckdb
import pytest

from claimlake.llm import queries

COLUMNS = {
    "p1_found": ["rec_table", "id", "defect"], "p2_found": ["id_a", "id_b"], "p3_found": ["doc_id_a", "doc_id_b"], "p4_found": ["rec_table", "rec_key", "pos"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(data + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    r = duck.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert sorted(tuple(map(str, x)) for x in df.select(*cols).collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        keys = [tuple(map(str, r)) for r in rows]
        assert len(set(keys)) == len(keys)
