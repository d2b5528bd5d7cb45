"""Flat tables of nested records: every value of every record comes out, every parent is there."""

import json

from claimlake.operators import nested


def test_tables_are_whole(spark):
    a = {"n": 1.50, "flag": True, "none": None, "odd": "[not json", "mesh": [{"t": 1, "syn": ["x", None, ["y"]]}, None, {}], "lone": {"k": "v", "deep": [{"z": 2}]}, "inner": json.dumps({"w": [7]})}
    b = {"mesh": {"t": 3}}
    rows = [("q", "1", "metadata", json.dumps(a)), ("q", "2", "metadata", json.dumps(json.dumps(b))), ("q", "3", "source_urls", '[{"url": "u"}]'), ("q", "4", "metadata", '{"a": 1'), ("q", "5", "metadata", None)]
    d = spark.createDataFrame(rows, "rec_table string, id string, root string, text string")
    got = sorted(((r.id, r.path, r.parent, r.name, r.place, r.value) for r in nested.tables(d).collect()), key=str)
    m = "metadata"
    want = [("1", m, None, "n", None, "1.5"), ("1", m, None, "flag", None, "true"), ("1", m, None, "none", None, None), ("1", m, None, "odd", None, "[not json")]
    want += [("1", m + ".mesh[0]", m, "t", None, "1"), ("1", m + ".mesh[0].syn", m + ".mesh[0]", None, 0, "x"), ("1", m + ".mesh[0].syn", m + ".mesh[0]", None, 1, None), ("1", m + ".mesh[0].syn[2]", m + ".mesh[0]", None, 0, "y")]
    want += [("1", m + ".mesh", m, None, 1, None), ("1", m + ".mesh[2]", m, None, None, None), ("1", m + ".lone", m, "k", None, "v"), ("1", m + ".lone.deep[0]", m + ".lone", "z", None, "2")]
    want += [("1", m + ".inner.w", m + ".inner", None, 0, "7"), ("1", m + ".inner", m, None, None, None)]
    want += [("2", m, None, None, None, None), ("2", m + ".mesh[0]", m, "t", None, "3"), ("3", "source_urls", None, None, None, None), ("3", "source_urls[0]", "source_urls", "url", None, "u")]
    assert got == sorted(want, key=str)
    assert nested.tables(d.where("false")).count() == 0


def test_query_keeps_every_value_and_parent(spark, data):
    from claimlake.plans import prepare

    t = prepare.p6_tables(spark, data)
    rows = t.collect()
    paths = {(r.rec_table, r.id, r.path) for r in rows}
    assert all(r.parent is None or (r.rec_table, r.id, r.parent) in paths for r in rows)
    want = 0
    for r in nested.qa_rows(prepare._t(spark, data, "qa_items"), prepare._t(spark, data, "qa_split_items")).collect():
        text = nested.unwrap(r.text)
        todo = [json.loads(text)] if text else []
        while todo:
            v = todo.pop()
            if isinstance(v, str) and nested.unwrap(v) is not None:
                v = json.loads(nested.unwrap(v))
            if isinstance(v, (dict, list)):
                todo += v.values() if isinstance(v, dict) else v
            else:
                want += v is not None
    assert sum(r.value is not None for r in rows) == want > 0
    elements = {(r.rec_table, r.id, r.path) for r in prepare.p6_found(spark, data).collect()}
    assert elements <= paths
