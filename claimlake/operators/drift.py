"""Record streams whose fields are added, renamed, removed or change type between files (problem 5).

Tagged-union inference: the schema of every file is inferred on its own (all files in parallel) and keeps, for every path
at any depth (``acc_nli.mean``, ``scores[]``), the set of JSON types that its non-null values have.  Neighbouring
files of a stream, by write time, are then fused: paths on one side only are added or removed, paths whose type
sets differ are retyped.  An added and a removed field are one renamed field if the runs that are in both files
keep their values under them.  :func:`table` gives one row a record, every field under the name it first had, split
into typed branches, with a canonical number; :func:`alternatives` reports every type of a path where it first appears.

Runs are told by their values, whatever the fields are called: a value (number, text or boolean, at any depth) that one
record alone has in each of two neighbouring files links these records; a pair is one run if each is the other's
best partner and they share at least ``kin`` of the smaller record's values.  So a value links at most one pair,
however often it occurs.

Defined cases: null, blank, broken and non-object lines are unreadable and do not count; repeated
lines count once; a field that is null everywhere exists but has no type, and its last known type
in the stream is compared; the first file of a stream has no changes; files written at the same
time are ordered by name; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlake.runtime import cut_lineage

#: Members of an object that hold its value, where other records have a plain number.
VALUE_MEMBERS = ("mean", "value")

_DDL = {
    "paths": "array<struct<path:string,kind:string>>", "leaves": "array<struct<field:string,leaves:array<bigint>>>",
    "values": "array<struct<field:string,kind:string,number:double,string:string,boolean:boolean,json:string,canonical:double>>",
}


def _refuse(text: str):
    raise ValueError(text)


def read(line: str | None) -> dict | None:
    """The object of a line, None if there is none."""
    if not line:
        return None
    try:
        value = json.loads(line, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def kind_of(x) -> str | None:
    """JSON type of a value, None for null."""
    if x is None:
        return None
    if isinstance(x, bool):
        return "boolean"
    return "string" if isinstance(x, str) else "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "number"


def number_of(x) -> float | None:
    """A finite number, or a text that is one as a whole."""
    if isinstance(x, bool) or not isinstance(x, (int, float, str)) or isinstance(x, str) and "_" in x:
        return None
    try:
        n = float(x)
    except (ValueError, OverflowError):
        return None
    return n if math.isfinite(n) else None


def canonical(x) -> float | None:
    """The number that a value stands for: itself, a text that is a number, the only item of an array, the one value member of an object."""
    while isinstance(x, (dict, list)):
        held = [x[k] for k in VALUE_MEMBERS if k in x] if isinstance(x, dict) else x
        if len(held) != 1:
            return None
        x = held[0]
    return number_of(x)


def _plain(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def walk(record: dict) -> tuple[list[tuple[str, str | None]], list[tuple[str, list[int]]]]:
    """The distinct (path, type) of a record at every depth, and the hashes of the values under each of its fields."""
    paths: dict[tuple[str, str | None], None] = {}
    fields = []
    for name, top in record.items():
        leaves: dict[int, None] = {}
        todo = [(name, top)]
        while todo:
            path, x = todo.pop()
            paths[_plain(path), kind_of(x)] = None
            if isinstance(x, dict):
                todo += [(f"{path}.{k}", v) for k, v in x.items()]
            elif isinstance(x, list):
                todo += [(f"{path}[]", v) for v in x]
            elif x is not None:
                n = number_of(x)
                text = repr(n + 0.0) if n is not None else x.strip() if isinstance(x, str) else f"\x00{x}"
                leaves[xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)] = None
        fields.append((_plain(name), list(leaves)))
    return list(paths), fields


def _structs(rows: list[list[tuple]], **types: pa.DataType) -> pa.ListArray:
    """Lists of tuples as lists of structs."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = [[x[j] for row in rows for x in row] for j in range(len(types))]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, types.values())], names=list(types)))


BRANCHES = {"field": pa.string(), "kind": pa.string(), "number": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "json": pa.string(), "canonical": pa.float64()}


def branches(field: str, x) -> tuple:
    """A value in the branch of its type, with its canonical number; in the order of BRANCHES."""
    k = kind_of(x)
    return _plain(field), k, number_of(x) if k == "number" else None, _plain(x) if k == "string" else None, x if k == "boolean" else None, _plain(json.dumps(x, ensure_ascii=False, separators=(",", ":"))) if k in ("array", "object") else None, canonical(x)


def records(lines: DataFrame, *wanted: str) -> DataFrame:
    """(record_kind, stream, file_name, written_at, line_no, rec, ...wanted): a row a readable record; ``rec`` is a hash of
    its content.  ``wanted`` are of paths, leaves and values."""
    head = ["record_kind", "stream", "file_name", "written_at", "line_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for o in range(0, whole.num_rows, 2000):
                b = whole.slice(o, 2000)
                at, rec = [], []
                paths, leaves, values = [], [], []
                for i, line in enumerate(b["line"].to_pylist()):
                    r = read(line)
                    if r is None:
                        continue
                    at.append(i)
                    rec.append(xxhash.xxh64_intdigest(json.dumps(r, sort_keys=True).encode()) - (1 << 63))
                    if "paths" in wanted or "leaves" in wanted:
                        p, x = walk(r)
                        paths.append(p)
                        leaves.append(x)
                    if "values" in wanted:
                        values.append([branches(f, x) for f, x in r.items()])
                columns = {"paths": lambda: _structs(paths, path=pa.string(), kind=pa.string()), "leaves": lambda: _structs(leaves, field=pa.string(), leaves=pa.list_(pa.int64())), "values": lambda: _structs(values, **BRANCHES)}
                take = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([*(b[c].take(take) for c in head), pa.array(rec, pa.int64()), *(columns[w]() for w in wanted)], names=[*head, "rec", *wanted])

    rows = lines.where("stream IS NOT NULL AND file_name IS NOT NULL AND line IS NOT NULL").select(F.col("kind").alias("record_kind"), "stream", "file_name", F.col("written_at").cast("timestamp").alias("written_at"), F.col("line_no").cast("long").alias("line_no"), "line")
    return rows.mapInArrow(run, ", ".join(["record_kind string, stream string, file_name string, written_at timestamp, line_no bigint, rec bigint", *(f"`{w}` {_DDL[w]}" for w in wanted)]))


def files(recs: DataFrame) -> DataFrame:
    """(stream, file_name, ord): the files of each stream in order of writing."""
    f = recs.groupBy("stream", "file_name").agg(F.min("written_at").alias("written_at"))
    return f.select("stream", "file_name", F.row_number().over(Window.partitionBy("stream").orderBy("written_at", "file_name")).alias("ord"))


def schemas(recs: DataFrame, order: DataFrame) -> DataFrame:
    """(stream, ord, file_name, path, kinds, old_kinds, previous, next_ord, last_ord): the type set of each path in each file;
    types of a file without values are those last known in the stream.  ``previous`` and ``next_ord`` are the files of the stream
    before and after that have the path, ``last_ord`` the stream's last file."""
    s = recs.select("stream", "file_name", F.explode("paths").alias("p")).groupBy("stream", "file_name", "p.path").agg(F.array_sort(F.collect_set("p.kind")).alias("own"))
    s = s.join(order.withColumn("last_ord", F.max("ord").over(Window.partitionBy("stream"))), ["stream", "file_name"])
    w = Window.partitionBy("stream", "path").orderBy("ord")
    s = s.withColumn("kinds", F.coalesce(F.last(F.when(F.size("own") > 0, F.col("own")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.array().cast("array<string>")))
    return s.select("stream", "ord", "file_name", "path", "own", "kinds", "last_ord", F.lag("kinds").over(w).alias("old_kinds"), F.lag("ord").over(w).alias("previous"), F.lead("ord").over(w).alias("next_ord"))


def steps(s: DataFrame) -> DataFrame:
    """(stream, ord, path, change) of all paths against the previous file, renames not yet known."""
    here = F.col("previous") == F.col("ord") - 1
    change = F.array(
        F.when((F.col("ord") > 1) & ~F.coalesce(here, F.lit(False)), F.struct("ord", F.lit("added").alias("change"))),
        F.when(here & (F.size("kinds") > 0) & (F.size("old_kinds") > 0) & (F.col("kinds") != F.col("old_kinds")), F.struct("ord", F.lit("retyped").alias("change"))),
        F.when((F.col("ord") < F.col("last_ord")) & ~F.coalesce(F.col("next_ord") == F.col("ord") + 1, F.lit(False)), F.struct((F.col("ord") + 1).alias("ord"), F.lit("removed").alias("change"))),
    )
    return s.select("stream", "path", F.explode(F.array_compact(change)).alias("c")).select("stream", "c.ord", "path", "c.change")


def renames(recs: DataFrame, order: DataFrame, changed: DataFrame, agree: float, kin: float) -> DataFrame:
    """(stream, ord, field, old_field): mutual best matches of added and removed fields by the values of shared runs.
    Only files whose step both adds and removes a field are looked at."""
    by = changed.groupBy("stream", "ord").agg(F.collect_set(F.when(F.col("change") == "added", F.col("path"))).alias("added"), F.collect_set(F.when(F.col("change") == "removed", F.col("path"))).alias("removed")).where("size(added) > 0 AND size(removed) > 0")
    own = recs.join(order, ["stream", "file_name"]).select("stream", "ord", "rec", "leaves").dropDuplicates(["stream", "ord", "rec"])

    def side(df: DataFrame, new: bool, ours: str) -> DataFrame:
        """Each record with the leaves of its changed fields, and all its values."""
        values = F.array_distinct(F.flatten(F.col("leaves.leaves")))
        return df.join(by, ["stream", "ord"]).select("stream", "ord", F.lit(new).alias("new"), "rec", values.alias("values"), F.expr(f"filter(leaves, x -> array_contains({ours}, x.field) AND size(x.leaves) > 0)").alias("changed"))

    both = cut_lineage(side(own, True, "added").unionByName(side(own.withColumn("ord", F.col("ord") + 1), False, "removed")))
    one = lambda new, what: F.min(F.when(F.col("new") == new, F.col(what)))
    value = both.select("stream", "ord", "new", "rec", F.size("values").alias("n"), F.explode("values").alias("v")).groupBy("stream", "ord", "v").agg(
        F.count_if("new").alias("c_new"), F.count_if(~F.col("new")).alias("c_old"), one(True, "rec").alias("a"), one(False, "rec").alias("b"), F.min("n").alias("n")
    )
    pairs = value.where("c_new = 1 AND c_old = 1").groupBy("stream", "ord", "a", "b").agg(F.count("*").alias("shared"), F.min("n").alias("n")).where(F.col("shared") >= F.greatest(F.lit(2.0), F.col("n") * kin))
    first = lambda c, d: F.row_number().over(Window.partitionBy("stream", "ord", c).orderBy(F.desc("shared"), d))
    runs = pairs.withColumn("i", first("a", "b")).withColumn("j", first("b", "a")).where("i = 1 AND j = 1").select("stream", "ord", "a", "b")
    of = lambda new, key, name: both.where(F.col("new") == new).select("stream", "ord", F.col("rec").alias(key), F.col("changed").alias(name))
    seen = runs.join(of(True, "a", "x"), ["stream", "ord", "a"]).join(of(False, "b", "y"), ["stream", "ord", "b"])
    each = seen.select("stream", "ord", F.explode("x").alias("x"), "y").select("stream", "ord", "x", F.explode("y").alias("y"))
    score = each.groupBy("stream", "ord", F.col("x.field").alias("field"), F.col("y.field").alias("old_field")).agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap("x.leaves", "y.leaves")).alias("eq"))
    score = score.where((F.col("eq") >= 1) & (F.col("eq") >= agree * F.col("n")))
    rank = lambda *c: F.row_number().over(Window.partitionBy("stream", "ord", *c).orderBy(F.desc("eq"), F.asc("n"), "field", "old_field"))
    return score.withColumn("r1", rank("field")).withColumn("r2", rank("old_field")).where("r1 = 1 AND r2 = 1").select("stream", "ord", "field", "old_field")


def _inferred(lines: DataFrame, agree: float, kin: float, *wanted: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Records, order of files, schemas of the fields, changes of the fields, renames."""
    recs = cut_lineage(records(lines, "paths", "leaves", *wanted))
    order = cut_lineage(files(recs))
    # a field is a path of its own in every record that has it
    top = recs.withColumn("paths", F.expr("filter(paths, p -> exists(leaves, x -> x.field = p.path))"))
    s = cut_lineage(schemas(top, order))
    changed = steps(s)
    return recs, order, s, changed, cut_lineage(renames(recs, order, changed, agree, kin))


def changes(lines: DataFrame, agree: float = 0.6, kin: float = 1 / 3) -> DataFrame:
    """(file_name, field, old_field, change): every change of a field against the previous file of the stream."""
    _, order, _, changed, renamed = _inferred(lines, agree, kin)
    gone = renamed.select("stream", "ord", F.explode(F.array(F.struct(F.col("field").alias("path"), F.lit("added").alias("change")), F.struct(F.col("old_field").alias("path"), F.lit("removed").alias("change")))).alias("x")).select("stream", "ord", "x.*")
    out = changed.join(gone, ["stream", "ord", "path", "change"], "left_anti").select("stream", "ord", F.col("path").alias("field"), F.lit("").alias("old_field"), "change")
    out = out.unionByName(renamed.select("stream", "ord", "field", "old_field", F.lit("renamed").alias("change")))
    return out.join(order, ["stream", "ord"]).select("file_name", "field", "old_field", "change")


def alternatives(lines: DataFrame) -> DataFrame:
    """(stream, path, kind, file_name, n_files): every type of every path at any depth, the first file that has it, and in how many it is."""
    recs = cut_lineage(records(lines, "paths"))
    seen = recs.select("stream", "file_name", F.explode("paths").alias("p")).select("stream", "file_name", "p.path", "p.kind").where("kind IS NOT NULL").distinct()
    return seen.join(files(recs), ["stream", "file_name"]).groupBy("stream", "path", "kind").agg(F.min_by("file_name", "ord").alias("file_name"), F.count("*").alias("n_files"))


def table(lines: DataFrame, agree: float = 0.6, kin: float = 1 / 3) -> DataFrame:
    """One consistent table, a row a record: (kind, stream, file_name, line_no, fields MAP<name, STRUCT<written_as, number, string,
    boolean, json, canonical>>).

    ``name`` is the one under which the field first appeared in its stream (renames followed), ``written_as`` the
    name in the file; conflicting types fall into their own branches; ``canonical`` is the number that a value stands for.
    """
    recs, order, s, _, known = _inferred(lines, agree, kin, "values")
    # follow renames backwards: each round steps every unresolved name one rename earlier
    names = s.select("stream", "file_name", "ord", F.col("path").alias("field")).withColumn("name", F.col("field")).withColumn("upto", F.col("ord"))
    k = known.select("stream", F.col("ord").alias("since"), F.col("field").alias("name"), "old_field")
    while True:
        j = names.join(k, ["stream", "name"], "left").groupBy("stream", "file_name", "field", "name", "upto").agg(F.max(F.when(F.col("since") <= F.col("upto"), F.struct("since", "old_field"))).alias("h"))
        step = cut_lineage(j.select("stream", "file_name", "field", F.coalesce("h.old_field", "name").alias("name"), F.coalesce(F.col("h.since") - 1, F.col("upto")).alias("upto"), F.col("h").isNotNull().alias("moved")))
        names = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    called = names.groupBy("stream", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("called"))  # the fields of one file
    # two fields of a record may go back to one name only if one of them came back; the later keeps its own name
    entry = "struct(called[x.field] AS key, struct(x.field AS written_as, x.number, x.string, x.boolean, x.json, x.canonical) AS value)"
    entries = F.expr(f"transform(values, x -> {entry})")
    rows = recs.join(called, ["stream", "file_name"]).withColumn("e", entries)
    own = F.expr("transform(e, (x, i) -> struct(CASE WHEN exists(slice(e, 1, i), y -> y.key = x.key) THEN x.value.written_as ELSE x.key END AS key, x.value AS value))")
    return rows.select(F.col("record_kind").alias("kind"), "stream", "file_name", "line_no", F.map_from_entries(own).alias("fields"))


def values(records_table: DataFrame) -> DataFrame:
    """The table of :func:`table` with a row a value."""
    return records_table.select("kind", "stream", "file_name", "line_no", F.explode("fields").alias("field", "v")).select("kind", "stream", "file_name", "line_no", "field", "v.*")
