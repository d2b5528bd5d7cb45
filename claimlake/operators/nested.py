"""Deeply nested JSON into flat tables with parent-child links (problem 6).

Vectorised structural indexing over whole batches: bit maps of quotes, escapes, brackets and
delimiters, string interiors and nesting depth by prefix sums, parents by a search in the
openings one level up, array places by counting commas.  Only the containers found this way are
looked at in Python, in one pass; whether a lone object is an element is then settled by a join with the paths under
which some record holds an array.

A path names an object by keys and 0-based places: ``metadata.a[0].b[1]``.  An object that stands alone
where other records hold an array is element 0 of it.

Defined cases: null, empty and malformed text gives no row; JSON inside strings (the whole value or
a member) is read; null elements keep their places and give no row; repeated rows of an id give
each path once, the latest delivery counts; other columns are ignored; an empty table gives no rows.
The flat tables of :func:`tables` hold every scalar, null ones too; text that only looks like JSON is a scalar.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.runtime import cut_lineage

#: Marks an object that stands alone under its key; resolved to [0] or nothing.
LONE = "\x00"
_PLACES = r"\[[^\]]*\]|\x00"


def unwrap(text: str | None) -> str | None:
    """The JSON text itself, out of any string around it; None if it is not valid JSON with an object or array."""
    while text is not None:
        try:
            value = json.loads(text)  # the exact check of what the index then cuts
        except (ValueError, RecursionError):
            return None
        if isinstance(value, (dict, list)):
            return text
        text = value if isinstance(value, str) else None
    return None


class Index:
    """Structural index of a batch of valid JSON texts."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join([*parts, b""])
        b = np.frombuffer(self.data, np.uint8)
        self.starts = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
        n = len(b)
        place = np.arange(n)
        slash = b == 92
        # an odd run of backslashes escapes what follows
        begin = slash & ~np.r_[False, slash[:-1]]
        run_start = np.maximum.accumulate(np.where(begin, place, 0))
        odd = slash & ((place - run_start) % 2 == 0)
        escaped = np.r_[False, odd[:-1]]
        quote = (b == 34) & ~escaped
        inside = (np.cumsum(quote) & 1).astype(bool)
        self.quotes = np.flatnonzero(quote)
        out = ~inside & ~quote
        opening = out & ((b == 123) | (b == 91))
        closing = out & ((b == 125) | (b == 93))
        depth = np.cumsum(opening.astype(np.int32)) - np.cumsum(closing.astype(np.int32))
        self.level = depth
        self.filled = np.r_[0, np.cumsum((b != 32) & (b != 9) & (b != 10) & (b != 13))]
        self.at = np.flatnonzero(opening)
        self.is_array = b[self.at] == 91
        self.depth = depth[self.at]
        ends = np.flatnonzero(closing)
        end_depth = depth[ends] + 1
        commas = np.flatnonzero(out & (b == 44))
        comma_depth = depth[commas]
        self.colons = colons = np.flatnonzero(out & (b == 58))
        self.own: dict[int, np.ndarray] = {}
        self.commas: dict[int, np.ndarray] = {}
        m = len(self.at)
        self.parent = np.full(m, -1, np.int64)
        self.place = np.zeros(m, np.int64)
        self.end = np.zeros(m, np.int64)
        previous = np.zeros(0, np.int64)
        for d in range(1, int(self.depth.max()) + 1 if m else 0):
            own = self.own[d] = np.flatnonzero(self.depth == d)
            self.commas[d] = commas[comma_depth == d]
            closes = ends[end_depth == d]
            self.end[own] = closes[np.searchsorted(closes, self.at[own])]
            if d > 1:
                up = previous[np.searchsorted(self.at[previous], self.at[own]) - 1]
                self.parent[own] = up
                c = self.commas[d - 1]
                self.place[own] = np.searchsorted(c, self.at[own]) - np.searchsorted(c, self.at[up])
            previous = own
        # the colon before a member's value, and the quotes around its key
        colon = np.searchsorted(colons, self.at) - 1
        self.colon = np.where(colon >= 0, colons[np.maximum(colon, 0)] if len(colons) else 0, -1)
        self.of = np.searchsorted(self.starts, self.at, "right") - 1

    def key(self, i: int) -> str:
        """Key of the member whose value is container ``i``."""
        q = int(np.searchsorted(self.quotes, self.colon[i])) - 1
        raw = self.data[self.quotes[q - 1] : self.quotes[q] + 1]
        return json.loads(raw) if 92 in raw else raw[1:-1].decode("utf-8", "surrogatepass")

    def string_members(self) -> list[tuple[int, str | int, str]]:
        """(container, key or place, text) of string values that may hold JSON themselves."""
        opens, closes = self.quotes[0::2], self.quotes[1::2]
        b = np.frombuffer(self.data, np.uint8)
        nxt = b[np.minimum(opens + 1, len(b) - 1)]
        # text that begins with a bracket, a quote or white space may be JSON; whatever a string ahead of a colon holds, it is a key
        k = np.flatnonzero((nxt == 123) | (nxt == 91) | (nxt == 92) | (nxt == 32))
        colon = np.r_[self.colons, len(b)][np.searchsorted(self.colons, closes[k])]
        key = (colon < len(b)) & (self.filled[np.minimum(colon, len(b))] == self.filled[closes[k] + 1])
        k = k[~key & (self.level[opens[k]] > 0)]
        out = []
        for i in k:
            a, z = int(opens[i]), int(closes[i])
            text = json.loads(self.data[a : z + 1])
            if text.lstrip()[:1] not in ("{", "[", '"'):
                continue
            d = int(self.level[a])
            own = self.own[d]
            c = int(own[np.searchsorted(self.at[own], a) - 1])
            if self.is_array[c]:
                commas = self.commas[d]
                out.append((c, int(np.searchsorted(commas, a) - np.searchsorted(commas, self.at[c])), text))
            else:
                q = 2 * int(i)
                out.append((c, json.loads(self.data[self.quotes[q - 2] : self.quotes[q - 1] + 1]), text))
        return out


def containers(texts: list[str], root: str) -> list[tuple[int, str, str, bool, bool, str]]:
    """(text, path, parent path, is element, is array, span) of all objects and arrays; lone objects carry the mark."""
    ix = Index(texts)
    paths: list[str] = []
    out = []
    for i in range(len(ix.at)):
        p = int(ix.parent[i])
        array = bool(ix.is_array[i])
        if p < 0:
            path, element, above = root, False, ""
        elif ix.is_array[p]:
            path, element, above = f"{paths[p]}[{ix.place[i]}]", True, paths[p]
        else:
            path, element, above = f"{paths[p]}.{ix.key(i)}" + ("" if array else LONE), False, paths[p]
        paths.append(path)
        out.append((int(ix.of[i]), path, above, element, array, ix.data[ix.at[i] : ix.end[i] + 1].decode("utf-8", "surrogatepass")))
    if any('"{' in t or '"[' in t or '"\\' in t or '" ' in t for t in texts):
        for c, name, text in ix.string_members():
            inner = unwrap(text)
            if inner is None:
                continue
            in_array = isinstance(name, int)
            # what is inside a lone object has its mark in the path too
            here = f"{paths[c]}[{name}]" if in_array else f"{paths[c]}.{name}" + (LONE if inner.lstrip()[:1] == "{" else "")
            for _, path, above, element, array, span in containers([inner], here):
                top = path == here
                out.append((int(ix.of[c]), path, paths[c] if top else above, element or (top and in_array and not array), array, span))
    return out


def generic(path: str) -> str:
    """Keys of a path without places and marks."""
    keep, skip = [], False
    for c in path:
        if c == "[":
            skip = True
        elif c == "]":
            skip = False
        elif not skip and c != LONE:
            keep.append(c)
    return "".join(keep)


def resolve(path: str, arrays: frozenset[str]) -> str:
    """The path with each lone mark as [0] where other records hold an array, else as nothing; :func:`resolved` does this for tables."""
    if LONE not in path:
        return path
    out = ""
    pieces = path.split(LONE)
    for i, piece in enumerate(pieces):
        out += piece
        if i < len(pieces) - 1 and generic(out) in arrays:
            out += "[0]"
    return out


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[str, list[int], list]]:
    """(root, row numbers, containers) of the valid texts of a batch, by root, in blocks."""
    roots, texts = batch["root"].to_pylist(), batch["text"].to_pylist()
    by: dict[str, list[tuple[int, str]]] = {}
    for i, (r, t) in enumerate(zip(roots, texts)):
        t = unwrap(t)
        if t is not None:
            by.setdefault(r, []).append((i, t))
    for root, rows in by.items():
        for s in range(0, len(rows), 500):
            some = rows[s : s + 500]
            yield root, [i for i, _ in some], containers([t for _, t in some], root)


def resolved(marked: DataFrame, *names: str) -> DataFrame:
    """``marked`` with the lone marks in its path columns settled: [0] where another record holds an array, else nothing.

    ``marked`` has rows (path, is_array, ...): those of arrays tell where records hold one.  The marks of a path are
    its prefixes; they are joined with the array paths, so nothing of the data goes to the driver.
    """
    general = lambda c: F.regexp_replace(c, _PLACES, "")
    arrays = marked.where("is_array").select(general("path").alias("g")).distinct()
    rows = marked.where("NOT is_array")
    plain, lone = rows, None
    has = F.lit(False)
    for name in names:
        has = has | F.coalesce(F.col(name).contains(LONE), F.lit(False))
    plain, lone = rows.where(~has), rows.where(has)
    # the longest path column holds the prefixes of all: a parent is above its path
    pieces = F.split(names[0], LONE)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.regexp_replace(F.array_join(F.slice(pieces, 1, i), ""), _PLACES, ""))
    marks = lone.select(names[0]).distinct().withColumn("p", F.explode(prefixes)).join(arrays.withColumnRenamed("g", "p"), "p").groupBy(names[0]).agg(F.collect_set("p").alias("held"))
    lone = lone.join(marks, names[0], "left")

    def settle(c: str):
        pieces = F.split(c, LONE)
        last = F.size(pieces)
        put = F.transform(pieces, lambda x, i: F.concat(x, F.when((i < last - 1) & F.array_contains(F.coalesce("held", F.array().cast("array<string>")), F.regexp_replace(F.array_join(F.slice(pieces, 1, i + 1), ""), _PLACES, "")), "[0]").otherwise("")))
        return F.array_join(put, "")

    return plain.unionByName(lone.select(*(settle(c).alias(c) if c in names else F.col(c) for c in rows.columns)))


def elements(rows: DataFrame) -> DataFrame:
    """(rec_table, id, path, parent, value): each object that is an array element, of rows (rec_table, id, root, text).
    ``parent`` is the path of the nearest object above (the root for the topmost), ``value`` the object's JSON text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, numbers, found in _parsed(batch):
                kept = [x for x in found if x[4] and not x[3] or not x[4] and (x[3] or x[1].endswith(LONE))]
                at = pa.array([numbers[x[0]] for x in kept], pa.int32())
                columns = [pa.array([_text(x[1]) for x in kept], pa.string()), pa.array([x[3] for x in kept], pa.bool_()), pa.array([x[4] for x in kept], pa.bool_()), pa.array([None if x[4] else _text(x[5]) for x in kept], pa.string())]
                yield pa.RecordBatch.from_arrays([batch["rec_table"].take(at), batch["id"].take(at), pa.array([root] * len(kept), pa.string()), *columns], names=["rec_table", "id", "root", "path", "is_element", "is_array", "value"])

    marked = cut_lineage(rows.select("rec_table", "id", "root", "text").mapInArrow(run, "rec_table string, id string, root string, path string, is_element boolean, is_array boolean, value string"))
    out = resolved(marked, "path").where("is_element OR endswith(path, ']')")
    above = F.regexp_extract(F.regexp_replace("path", r"\[[^\]]*\]$", ""), r"^(.*\])", 1)
    return out.select("rec_table", "id", "path", F.when(above == "", F.col("root")).otherwise(above).alias("parent"), "value")


def qa_rows(qa_items: DataFrame, qa_split_items: DataFrame) -> DataFrame:
    """(rec_table, id, root, text) of qa_items.metadata and qa_split_items.source_urls, latest delivery of each id."""
    m = qa_items.where("id IS NOT NULL").groupBy("id").agg(F.max_by("metadata", F.struct("loaded_at", "metadata")).alias("text"))
    u = qa_split_items.where("id IS NOT NULL").select("id", "released_at", F.to_json("source_urls").alias("text")).groupBy("id").agg(F.max_by("text", F.struct("released_at", "text")).alias("text"))
    m = m.where("text IS NOT NULL").select(F.lit("qa_items").alias("rec_table"), "id", F.lit("metadata").alias("root"), "text")
    u = u.where("text IS NOT NULL AND text <> '[]'").select(F.lit("qa_split_items").alias("rec_table"), "id", F.lit("source_urls").alias("root"), "text")
    return m.unionByName(u)


def scalars(found: DataFrame) -> DataFrame:
    """Flat table of the elements: (rec_table, id, path, parent, fields MAP<STRING, STRING>) with scalar members only."""
    members = F.from_json("value", "map<string,string>")
    flat = F.map_filter(members, lambda k, v: v.isNull() | ~(v.startswith("{") | v.startswith("[")))
    return found.select("rec_table", "id", "path", "parent", flat.alias("fields"))


class _Members(list):
    """The members of a JSON object as (key, value), all of a repeated key."""


class _Written(str):
    """A number as it is written."""


def _value(text: str):
    return json.loads(text, object_pairs_hook=_Members, parse_float=_Written, parse_int=_Written, parse_constant=_Written)


def _read(x):
    """The JSON inside a string, else the value itself."""
    if isinstance(x, str) and x.lstrip()[:1] in ("{", "[", '"'):
        inner = unwrap(x)
        return x if inner is None else _value(inner)
    return x


def _text(x) -> str | None:
    if isinstance(x, str):
        return x if x.isascii() else x.encode("utf-8", "replace").decode()
    return None if x is None else "true" if x else "false"


def flat(text: str, root: str) -> Iterator[tuple[str, str | None, str | None, int | None, str | None, bool]]:
    """(path, parent, name, place, value, is_array) of a valid text: one row for each array that is a member, and each scalar member of each object, and each scalar item of each
    array with its place.  An object without scalars and a root have a row of their own, so that every ``parent``, the
    nearest object above or the root, is there; lone objects carry the mark."""
    value = _value(text)
    if not isinstance(value, _Members):
        yield root, None, None, None, None, False
    todo = [(value, root, None if isinstance(value, _Members) else root)]
    while todo:
        value, path, parent = todo.pop()
        if isinstance(value, _Members):
            empty = True
            for k, x in value:
                x = _read(x)
                if isinstance(x, list):
                    if not isinstance(x, _Members):
                        yield f"{path}.{k}", None, None, None, None, True
                    todo.append((x, f"{path}.{k}" + (LONE if isinstance(x, _Members) else ""), path))
                else:
                    empty = False
                    yield path, parent, k, None, _text(x), False
            if empty:
                yield path, parent, None, None, None, False
        else:
            for i, x in enumerate(value):
                x = _read(x)
                if isinstance(x, list):
                    todo.append((x, f"{path}[{i}]", parent))
                else:
                    yield path, parent, None, i, _text(x), False


def tables(rows: DataFrame) -> DataFrame:
    """(rec_table, id, path, parent, name, place, value): all objects, root and lone ones too, with their scalar members by
    ``name``, and all scalar array items by the array's ``path`` and their ``place``, of rows (rec_table, id, root, text)."""
    schema = pa.schema([("path", pa.string()), ("parent", pa.string()), ("name", pa.string()), ("place", pa.int32()), ("value", pa.string()), ("is_array", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, texts = batch["root"].to_pylist(), batch["text"].to_pylist()
            for s in range(0, len(texts), 500):
                at: list[int] = []
                out: list[tuple] = []
                for i in range(s, min(s + 500, len(texts))):
                    text = unwrap(texts[i])
                    if text is None:
                        continue
                    for path, parent, name, place, value, array in flat(text, roots[i]):
                        at.append(i)
                        out.append((_text(path), _text(parent), _text(name), place, value, array))
                take = pa.array(at, pa.int32())
                columns = [pa.array([r[j] for r in out], f.type) for j, f in enumerate(schema)]
                yield pa.RecordBatch.from_arrays([batch["rec_table"].take(take), batch["id"].take(take), *columns], names=["rec_table", "id", *schema.names])

    marked = cut_lineage(rows.select("rec_table", "id", "root", "text").mapInArrow(run, "rec_table string, id string, path string, parent string, name string, place int, value string, is_array boolean"))
    return resolved(marked, "path", "parent").drop("is_array")
