"""Schema drift and nested records: small fixtures, edge cases, brute force."""

import datetime as dt
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from claimlake.operators import drift, nested

SCHEMA = "file_name string, kind string, stream string, written_at timestamp, line_no int, line string"
T = [dt.datetime(2025, 1, d) for d in (1, 2, 3, 4)]


def frame(spark, rows):
    return spark.createDataFrame([(f, "Row", s, t, i, json.dumps(x) if isinstance(x, dict) else x) for f, s, t, i, x in rows], SCHEMA)


def test_changes(spark):
    a1, a2 = {"id": "r1", "acc": 0.12345, "f1": 0.51111, "old": 1}, {"id": "r2", "acc": 0.23456, "f1": 0.52222, "old": 2}
    b1, b2 = {"id": "r1", "accuracy": 0.12345, "f1": "0.51111", "acc_dev": 0.99999}, {"id": "r2", "accuracy": 0.23456, "f1": "0.52222", "acc_dev": 0.88888}
    rows = [("a", "s", T[0], 1, a1), ("a", "s", T[0], 2, a2), ("b", "s", T[1], 1, b1), ("b", "s", T[1], 2, b2), ("b", "s", T[1], 3, b2), ("b", "s", T[1], 4, '{"broken":'), ("b", "s", T[1], 5, ""), ("b", "s", T[1], 6, None), ("b", "s", T[1], 7, "[1]")]
    rows += [("c", "s", T[2], 1, {"id": "r9", "accuracy": None, "f1": None, "acc_dev": 0.7}), ("d", "s", T[3], 1, {"id": "r9", "accuracy": [0.5], "f1": "x", "acc_dev": 0.7}), ("z", "other", T[1], 1, {"q": 1})]
    got = {tuple(r) for r in drift.changes(frame(spark, rows)).collect()}
    assert got == {("b", "accuracy", "acc", "renamed"), ("b", "f1", "", "retyped"), ("b", "acc_dev", "", "added"), ("b", "old", "", "removed"), ("d", "accuracy", "", "retyped")}
    t = {(r.file_name, r.line_no, r.written_as): r for r in drift.values(drift.table(frame(spark, rows))).collect()}
    assert t["b", 1, "accuracy"].field == "acc" and t["b", 1, "f1"].string == "0.51111" and t["b", 1, "f1"].canonical == 0.51111
    assert t["d", 1, "accuracy"].json == "[0.5]" and t["d", 1, "accuracy"].field == "acc" and t["d", 1, "accuracy"].canonical == 0.5


def test_chained_renames(spark):
    v = [{"k": f"r{i}", "x": 0.11111 + i} for i in range(3)]
    rows = []
    for name, t, field in (("a", T[0], "x"), ("b", T[1], "y"), ("c", T[2], "z")):
        rows += [(name, "s", t, i, {"k": r["k"], field: r["x"], "w": 7.77777 + i}) for i, r in enumerate(v)]
    got = {tuple(r) for r in drift.changes(frame(spark, rows)).collect()}
    assert got == {("b", "y", "x", "renamed"), ("c", "z", "y", "renamed")}
    assert {r.field for r in drift.values(drift.table(frame(spark, rows))).where("written_as IN ('x', 'y', 'z')").collect()} == {"x"}


def test_renamed_text_and_one_row_a_record(spark):
    v = [{"run": f"r{i}", "f1": 0.5 + i, "n": 100 + i, "note": f"words {i} of a note"} for i in range(6)]
    rows = [("a", "s", T[0], i, r) for i, r in enumerate(v)] + [("b", "s", T[1], i, {**{k: x for k, x in r.items() if k != "note"}, "remark": r["note"]}) for i, r in enumerate(v)]
    d = frame(spark, rows)
    assert {tuple(r) for r in drift.changes(d).collect()} == {("b", "remark", "note", "renamed")}
    t = {(r.file_name, r.line_no): r.fields for r in drift.table(d).collect()}
    assert len(t) == 12 and t["b", 3]["note"].string == "words 3 of a note" and t["b", 3]["note"].written_as == "remark"
    assert t["a", 2]["run"].canonical is None and t["a", 2]["n"].canonical == 102


def test_canonical_numbers():
    for value, want in ((2, 2.0), ("0.5", 0.5), ("r02", None), ([0.5], 0.5), (["0.5"], 0.5), ([1, 2], None), ({"mean": 0.1, "sd": 3}, 0.1), ({"count": 900, "mean": 0.12345}, 0.12345), ({"count": 900}, None), (True, None), (None, None), ({"mean": 1, "value": 2}, None), ("1_0", None), ("nan", None)):
        assert drift.canonical(value) == want, value


def test_alternatives_at_every_depth(spark):
    rows = [("a", "s", T[0], 1, {"acc": {"mean": 1, "runs": [1, "x"]}}), ("b", "s", T[1], 1, {"acc": {"mean": "1", "runs": [{"id": None}]}})]
    got = {(r.path, r.kind, r.file_name, r.n_files) for r in drift.alternatives(frame(spark, rows)).collect()}
    assert got == {("acc", "object", "a", 2), ("acc.mean", "number", "a", 1), ("acc.mean", "string", "b", 1), ("acc.runs", "array", "a", 2), ("acc.runs[]", "number", "a", 1), ("acc.runs[]", "string", "a", 1), ("acc.runs[]", "object", "b", 1)}


def test_repeated_values_link_no_pairs(spark):
    # one value in all rows of both files: a join on it would make n * n pairs
    rows = [(f, "s", t, i, {"same": 7.5, "k": f"{f}{i}", f: i}) for f, t in (("a", T[0]), ("b", T[1])) for i in range(3000)]
    assert {tuple(r) for r in drift.changes(frame(spark, rows)).collect()} == {("b", "a", "", "removed"), ("b", "b", "", "added")}


def test_drift_empty_and_clashing_columns(spark):
    d = frame(spark, [("a", "s", T[0], 1, {"x": 1})]).selectExpr("*", "'c' AS field", "1 AS ord", "'v' AS m")
    assert drift.changes(d).count() == 0 and drift.changes(d.where("false")).count() == 0
    assert drift.values(drift.table(d)).first().canonical == 1.0


def paths_of(rec, arrays):
    """Brute force over parsed values."""
    out = []

    def sub(v):
        if isinstance(v, str) and v[:1] in ("{", "["):
            try:
                w = json.loads(v)
                return w if isinstance(w, (dict, list)) else v
            except ValueError:
                return v
        return v

    def walk(o, p, g):
        o = sub(o)
        if isinstance(o, dict):
            for k, v in o.items():
                v, gg = sub(v), f"{g}.{k}"
                here = f"{p}.{k}"
                if isinstance(v, dict) and gg in arrays:
                    here += "[0]"
                    out.append(here)
                walk(v, here, gg)
        elif isinstance(o, list):
            for i, v in enumerate(o):
                v = sub(v)
                if isinstance(v, dict):
                    out.append(f"{p}[{i}]")
                walk(v, f"{p}[{i}]", g)

    walk(rec, "m", "m")
    return sorted(out)


def found_paths(text, arrays):
    out = []
    for _, path, _, element, array, _ in nested.containers([text], "m"):
        full = nested.resolve(path, arrays)
        if not array and (element or full.endswith("]")):
            out.append(full)
    return sorted(out)


def test_index_on_hard_texts():
    rec = {"a": [{"b": [None, {"c": {"d": [{}, []]}}], 'q"\\': [{"x": "}{][,:\\\""}]}, None, 5, "s"], "lone": {"k": {"z": 1}}, "é": [[{"n": 1}], [{"n": 2}, {"n": 3}]]}
    for text in (json.dumps(rec), json.dumps(rec, indent=2), json.dumps(rec, ensure_ascii=False)):
        assert found_paths(text, frozenset()) == paths_of(rec, frozenset())
        assert found_paths(text, frozenset({"m.lone", "m.lone.k"})) == paths_of(rec, frozenset({"m.lone", "m.lone.k"}))
    inner = {"p": json.dumps([{"x": [{"y": 1}]}, {"z": 2}]), "o": json.dumps({"w": [{"v": 1}]}), "l": ["{bad", json.dumps({"u": [{}]})]}
    assert found_paths(json.dumps(inner), frozenset()) == paths_of(inner, frozenset())


values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(alphabet='ab"\\{}[],: é', max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", 'k"', "c d"]), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.sampled_from(["a", "b", "x"]), values, max_size=3))
def test_index_is_exact(rec):
    assert found_paths(json.dumps(rec), frozenset({"m.a"})) == paths_of(rec, frozenset({"m.a"}))


def test_elements(spark):
    a = {"mesh": [{"t": 1}, None, {"t": 2}]}
    rows = [("q", "1", "metadata", json.dumps(a)), ("q", "2", "metadata", json.dumps({"mesh": {"t": 3, "q": {"u": 1}}})), ("q", "3", "metadata", json.dumps(json.dumps(a))), ("q", "4", "metadata", '{"mesh": [{"t": 1}'), ("q", "5", "metadata", ""), ("q", "6", "metadata", None), ("q", "7", "metadata", "5")]
    d = spark.createDataFrame(rows, "rec_table string, id string, root string, text string")
    e = nested.elements(d)
    got = {(r.id, r.path, r.parent) for r in e.collect()}
    assert got == {("1", "metadata.mesh[0]", "metadata"), ("1", "metadata.mesh[2]", "metadata"), ("2", "metadata.mesh[0]", "metadata"), ("3", "metadata.mesh[0]", "metadata"), ("3", "metadata.mesh[2]", "metadata")}
    assert {r.id: r.fields for r in nested.scalars(e).where("path = 'metadata.mesh[0]'").collect()}["2"] == {"t": "3"}
    assert nested.elements(d.where("false")).count() == 0


def test_latest_delivery_counts(spark):
    t = dt.datetime(2025, 1, 1)
    q = spark.createDataFrame([("1", '{"a":[{}]}', t, "x"), ("1", '{"a":[{},{}]}', t + dt.timedelta(1), "x"), (None, '{"a":[{}]}', t, "x")], "id string, metadata string, loaded_at timestamp, text string")
    u = spark.createDataFrame([("1", [("u", None), None], t)], "id string, source_urls array<struct<url string, mirrors array<struct<url string>>>>, released_at timestamp")
    got = sorted(r.path for r in nested.elements(nested.qa_rows(q, u)).collect())
    assert got == ["metadata.a[0]", "metadata.a[1]", "source_urls[0]"]


def test_lone_objects_inside_strings_and_many_layers(spark):
    text = json.dumps({"b": [{"c": 1}]})
    for _ in range(7):
        text = json.dumps(text)
    rows = [("q", "1", "m", json.dumps({"a": [{"q": [{"n": 1}]}]})), ("q", "2", "m", json.dumps({"a": json.dumps({"q": [{"n": 1}, {"n": 2}]})})), ("q", "3", "m", json.dumps({"a": json.dumps([None, {"q": {"n": 5}}])})), ("q", "4", "m", json.dumps({"deep": text})), ("q", "5", "m", json.dumps({"b": " " + json.dumps([{"c": 2}]) + " ", 'k {"': 1}))]
    d = spark.createDataFrame(rows, "rec_table string, id string, root string, text string")
    got = {(r.id, r.path, r.parent) for r in nested.elements(d).collect()}
    assert got == {("1", "m.a[0]", "m"), ("1", "m.a[0].q[0]", "m.a[0]"), ("2", "m.a[0]", "m"), ("2", "m.a[0].q[0]", "m.a[0]"), ("2", "m.a[0].q[1]", "m.a[0]"), ("3", "m.a[1]", "m"), ("3", "m.a[1].q[0]", "m.a[1]"), ("4", "m.deep.b[0]", "m"), ("5", "m.b[0]", "m")}
    flat = {(r.id, r.path, r.parent, r.name) for r in nested.tables(d).where("name IS NOT NULL").collect()}
    assert {("2", "m.a[0].q[1]", "m.a[0]", "n"), ("3", "m.a[1].q[0]", "m.a[1]", "n"), ("4", "m.deep.b[0]", "m.deep", "c")} <= flat
