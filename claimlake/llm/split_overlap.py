"""Evaluation questions that recur in the training split (problem 2).

Two questions overlap if the Jaccard coefficient of their word sets reaches ``least``.  Put the
distinct words of every question in one global order, rare words first.  Then the number of
insertions and deletions between two such strings of words is the size of the symmetric
difference, so the search is an edit-distance join with a bound k that follows from the lengths:

* an evaluation string of n words is cut into k+1 segments of n/(k+1) words, the longer ones last, where the words are
  common; at least one of them is untouched by k edits;
* a training string gives its substrings of the lengths and at the positions that the evaluation strings of all lengths
  in reach may have;
* pairs that share a segment at allowed positions, and whose two 64-bit parity sketches each differ in at
  most k bits (each edit flips one), are settled by banded dynamic programming.

Nothing is lost: the search is exact for strings of every length.  Word frequencies, which give the order, are counted over
all questions in a sketch of fixed size, and any order gives the same result.

Defined cases: null questions and questions without words: in no pair; null or other split
spellings: neither side; repeated rows: each pair once; the same question many times is one class until the
pairs are written; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm import textkit, tiles
from claimlake.runtime import cut_lineage, width

SKETCH = 1 << 18
ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("sketch", "<u8"), ("other", "<u8"), ("n", "<i4"), ("pos", "<u2"), ("side", "i1")])
# The split spellings of the input.
EVALUATION = ("validation", "val", "dev", "test")


def sides(items: DataFrame, id_col: str = "id", split_col: str = "split", text_col: str = "question") -> DataFrame:
    """(id, side, text): side 0 for training, 1 for evaluation; other rows are left out."""
    s = F.lower(F.regexp_replace(F.col(f"`{split_col}`"), r"(?U)^\s+|\s+$", ""))
    side = F.when(s == "train", 0).when(s.isin(*EVALUATION), 1)
    return items.select(F.col(f"`{id_col}`").alias("id"), side.alias("side"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND side IS NOT NULL AND text IS NOT NULL")


def sets_of(texts: list[str]) -> list[np.ndarray]:
    low = [textkit.fold(t) for t in texts]
    return [s for a, b in textkit.blocks(low) for s in textkit.word_sets(low[a:b])]


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def frequencies(rows: DataFrame) -> np.ndarray:
    """log2 of the word counts by hash bucket, over all rows: SKETCH bytes, whatever the data."""
    chunk = SKETCH // 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            s = sets_of(b["text"].to_pylist())
            if s:
                total += np.bincount(_buckets(np.concatenate(s)), minlength=SKETCH)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(16), pa.int32()), "v": pa.array([total[i * chunk : (i + 1) * chunk].tobytes() for i in range(16)], pa.binary())})

    got = textkit.added(rows.select("text").mapInArrow(run, "chunk int, v binary"), "chunk", "int", np.int64).collect()  # SKETCH counts
    out = np.zeros(SKETCH, np.uint8)
    for r in got:
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.log2(1 + np.frombuffer(r["v"], np.int64)).astype(np.uint8)
    return out


def most_edits(n: int, m: int, least: float) -> int:
    """Largest symmetric difference of sets of n and m elements that reach ``least``."""
    return math.floor((n + m) * (1 - least) / (1 + least) + 1e-9)


@functools.lru_cache(maxsize=4096)
def segments(n: int, least: float) -> tuple[tuple[int, int], ...]:
    """(begin, length) of the k+1 segments of an evaluation string of n words, k for the longest training string in reach."""
    parts = most_edits(n, math.floor(n / least + 1e-9), least) + 1
    q, longer = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        size = q + (i >= parts - longer)
        out.append((at, size))
        at += size
    return tuple(out)


@functools.lru_cache(maxsize=1024)
def substrings(m: int, least: float) -> tuple[tuple[int, np.ndarray], ...]:
    """(length, begins) of the substrings of a training string of m words that may be a segment of an evaluation string."""
    wanted: dict[int, np.ndarray] = {}
    for n in range(math.ceil(least * m - 1e-9), math.floor(m / least + 1e-9) + 1):
        k = most_edits(n, m, least)
        for at, size in segments(n, least):
            if size <= m:
                mask = wanted.setdefault(size, np.zeros(m - size + 1, bool))
                mask[max(0, at - k) : at + k + 1] = True
    return tuple((size, np.flatnonzero(mask)) for size, mask in sorted(wanted.items()))


@functools.lru_cache(maxsize=4096)
def wanted(n: int, side: int, least: float) -> tuple[tuple[int, np.ndarray], ...]:
    """(length, begins) of the segments (side 1, evaluation) or substrings (side 0) of a string of n words."""
    if not side:
        return substrings(n, least)
    by: dict[int, list[int]] = {}
    for at, size in segments(n, least):
        by.setdefault(size, []).append(at)
    return tuple((size, np.array(at)) for size, at in sorted(by.items()))


def entries_of(sets: list[np.ndarray], sides: np.ndarray, nodes: np.ndarray, order: np.ndarray, least: float) -> np.ndarray:
    """The ENTRY records of non-empty word sets, whole batches at a time."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    begin = np.cumsum(n) - n
    one = np.uint64(1)
    sketch, other = (np.bitwise_xor.reduceat(np.left_shift(one, (flat >> np.uint64(shift)) & np.uint64(63)), begin) for shift in (0, 6))
    # the words of each string, rare ones first
    words = flat[np.lexsort((flat, order[_buckets(flat)], np.repeat(np.arange(len(n)), n)))]
    runs, size = [words], 1
    out = []
    for m in np.unique(n):
        for side in (0, 1):
            own = np.flatnonzero((n == m) & (sides == side))
            if not len(own):
                continue
            for length, at in wanted(int(m), side, least):
                while size < length:
                    runs.append(runs[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + words[size:])
                    size += 1
                e = np.empty((len(own), len(at)), ENTRY)
                e["key"] = textkit.mix64(runs[length - 1][begin[own][:, None] + at] + np.uint64(length))
                for name, v in (("node", nodes), ("sketch", sketch), ("other", other)):
                    e[name] = v[own][:, None]
                e["n"], e["pos"], e["side"] = m, np.minimum(at, 65535), side
                out.append(e.ravel())
    return np.concatenate(out)


def _may_match(e: np.ndarray, t: np.ndarray, least: float) -> np.ndarray:
    """Which aligned entries agree in length, position and sketch as far as the edits allow."""
    n, m = e["n"].astype(np.int64), t["n"].astype(np.int64)
    k = np.floor((n + m) * (1 - least) / (1 + least) + 1e-9)
    near = np.abs(e["pos"].astype(np.int64) - t["pos"]) <= k
    return near & (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9) & (np.bitwise_count(e["sketch"] ^ t["sketch"]) <= k) & (np.bitwise_count(e["other"] ^ t["other"]) <= k)


def _cross(ev: np.ndarray, tr: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs of two entry blocks that may match: sketches meet as a matrix of exclusive-ors, tile by tile."""
    left, right = [], []
    for i in range(0, len(ev), tiles.TILE):
        e = ev[i : i + tiles.TILE]
        for j in range(0, len(tr), 16 * tiles.TILE):
            t = tr[j : j + 16 * tiles.TILE]
            if t["n"].max() < least * e["n"].min() - 1e-9 or e["n"].max() < least * t["n"].min() - 1e-9:
                continue  # population counts differ beyond the radius
            most = (int(e["n"].max()) + int(t["n"].max())) * (1 - least) / (1 + least) + 1e-9
            x, y = np.nonzero(np.bitwise_count(np.ascontiguousarray(e["sketch"])[:, None] ^ np.ascontiguousarray(t["sketch"])[None, :]) <= most)
            ok = _may_match(e[x], t[y], least)
            left.append(e["node"][x[ok]])
            right.append(t["node"][y[ok]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


#: Pairs of a key up to which they are looked at in its own task, and entries of either side of a work item beyond.
HOT, SIDE = 1 << 24, 1 << 12


def _reduce(rows: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Work items of the evaluation and training strings that share a segment at allowed positions: aligned node
    blocks, or for hot keys crossed entry blocks, which any task can expand."""
    rows = np.sort(rows, order=["key", "n"])
    ev, tr = rows[rows["side"] == 1], rows[rows["side"] == 0]
    key, begin, count = np.unique(ev["key"], return_index=True, return_counts=True)
    lo, hi = np.searchsorted(tr["key"], key, "left"), np.searchsorted(tr["key"], key, "right")
    product = count * (hi - lo)
    left, right = [], []
    for g in np.flatnonzero(product > 4096):
        e, t = ev[begin[g] : begin[g] + count[g]], tr[lo[g] : hi[g]]
        if product[g] <= HOT:
            x, y = _cross(e, t, least)
            left.append(x)
            right.append(y)
            if sum(map(len, left)) > 1 << 20:
                yield tiles._items(left, right)
                left, right = [], []
            continue
        for i in range(0, len(e), SIDE):
            for j in range(0, len(t), SIDE):
                yield pa.RecordBatch.from_pydict({"a": pa.array([e[i : i + SIDE].tobytes()], pa.binary()), "b": pa.array([t[j : j + SIDE].tobytes()], pa.binary()), "crossed": [True]})
    if left:
        yield tiles._items(left, right)
    small = np.flatnonzero((product > 0) & (product <= 4096))
    at = np.repeat(begin[small] - (np.cumsum(count[small]) - count[small]), count[small]) + np.arange(count[small].sum())
    ev, width, lo = ev[at], np.repeat((hi - lo)[small], count[small]), np.repeat(lo[small], count[small])
    ends = np.cumsum(width)
    start = 0
    while start < len(ev):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
        c = width[start:stop]
        x = np.repeat(np.arange(start, stop), c)
        y = np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[start:stop], c)
        ok = _may_match(ev[x], tr[y], least)
        if ok.any():
            yield tiles._items([ev["node"][x[ok]]], [tr["node"][y[ok]]])
        start = stop


def _expand(items: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b), a < b, of the work items, which are spread over all tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, crossed in zip(*(batch[c].to_pylist() for c in ("a", "b", "crossed"))):
                if crossed:
                    x, y = _cross(np.frombuffer(a, ENTRY), np.frombuffer(b, ENTRY), least)
                else:
                    x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                lo, hi = np.minimum(x, y), np.maximum(x, y)
                p = np.unique(np.stack((lo[lo < hi], hi[lo < hi])), axis=1)
                yield pa.RecordBatch.from_pydict({"a": pa.array(p[0]), "b": pa.array(p[1])})

    return items.repartition(width(items.sparkSession)).mapInArrow(run, "a long, b long").distinct()


def banded(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Jaccard of index pairs from the insertions and deletions between the sorted strings, by dynamic
    programming over the band that the bound leaves, for many pairs at once; 0 outside the band."""
    out = np.zeros(len(left))
    size = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    n, m = size[left], size[right]
    bound = np.floor((n + m) * (1 - least) / (1 + least) + 1e-9).astype(np.int64)
    ok = np.flatnonzero((np.abs(n - m) <= bound) & (n > 0) & (m > 0))
    for k in np.unique(bound[ok]):
        at = ok[bound[ok] == k]
        rows = int(n[at].max())
        x = np.zeros((len(at), rows), np.uint64)
        y = np.zeros((len(at), rows + 2 * k + 2), np.uint64)
        for i, (a, b) in enumerate(zip(left[at], right[at])):
            x[i, : size[a]] = sets[a]
            y[i, k : k + size[b]] = sets[b]
        far = 1 << 20
        # column d of row i stands for j = i + d - k; the last column is only a border
        step = np.arange(2 * k + 1)
        band = np.full((len(at), 2 * k + 2), far)
        band[:, :-1] = np.where(step >= k, step - k, far)
        final = np.full(len(at), far)
        for i in range(1, rows + 1):
            same = x[:, i - 1, None] == y[:, i - 1 : i + 2 * k]
            new = np.minimum(band[:, 1:] + 1, np.where(same, band[:, :-1], far))
            if i <= k:
                new[:, : k - i] = far
                new[:, k - i] = i
            band[:, :-1] = np.minimum.accumulate(new - step, axis=1) + step  # insertions along the row
            done = np.flatnonzero(n[at] == i)
            final[done] = band[done, m[at[done]] - i + k]
        good = final <= k
        total = (n + m)[at]
        out[at[good]] = ((total - final) / (total + final))[good]
    return out


def links(items: DataFrame, least: float = 0.8, id_col: str = "id", split_col: str = "split", text_col: str = "question") -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, side, node); links (a, b, jaccard) of different classes, a < b, of which one
    has an evaluation member and the other a training member."""
    rows = sides(items, id_col, split_col, text_col)
    order = rows.sparkSession.sparkContext.broadcast(frequencies(rows))  # SKETCH bytes
    kind = items.schema[id_col].dataType.simpleString()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sets_of(b["text"].to_pylist())
            ok = pa.array([len(x) > 0 for x in s])
            node = pa.array(textkit.set_hashes(s))
            yield pa.RecordBatch.from_arrays([b["id"].filter(ok), b["side"].filter(ok), node.filter(ok)], names=["id", "side", "node"])

    members = cut_lineage(rows.mapInArrow(classes, f"id {kind}, side int, node long").distinct())

    def entries(batch: pa.RecordBatch, seen: set) -> np.ndarray:
        sets = sets_of(batch["text"].to_pylist())
        nodes, sides = textkit.set_hashes(sets), batch["side"].to_numpy()
        fresh = []
        for i, key in enumerate(zip(nodes.tolist(), sides.tolist())):
            if len(sets[i]) and key not in seen:
                seen.add(key)
                fresh.append(i)
        if not fresh:
            return np.zeros(0, ENTRY)
        return entries_of([sets[i] for i in fresh], sides[fresh], nodes[fresh], order.value, least)

    n = items.count()
    parts = tiles.parts_for(rows, 30, n)
    # a string has a key at most once a position: a key may have as many entries as words, few in questions
    blocks = tiles.split_hot(tiles.scatter(rows.select("side", "text"), entries, parts), n, parts, ENTRY)
    cand = _expand(tiles.gather(blocks, lambda r: _reduce(r, least), "a binary, b binary, crossed boolean", parts, ENTRY), least)
    return members, _settle(cut_lineage(cand), rows.select("id", "text"), members, least)


def _settle(cand: DataFrame, texts: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Only the classes of candidates need a text; an id may come with two, only that of the class itself may stand for it."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(textkit.set_hashes(sets_of(b["text"].to_pylist()))), b["text"]], names=["id", "text"])

    nodes = cand.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    by_class = cut_lineage(texts.join(one.select("id").distinct(), "id", "left_semi").select("text").mapInArrow(own, "id long, text string").dropDuplicates(["id"]))
    return tiles.verify(cand, one.select("node", F.col("node").alias("id")), by_class, sets_of, lambda s, x, y: banded(s, x, y, least), least)


def pairs(items: DataFrame, least: float = 0.8, **columns: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of a training and an evaluation id."""
    members, between = links(items, least, **columns)
    x = members.select(F.col("id").alias("x"), F.col("side").alias("sx"), F.col("node").alias("a"))
    y = members.select(F.col("id").alias("y"), F.col("side").alias("sy"), F.col("node").alias("b"))
    across = between.join(x, "a").join(y, "b").where("sx <> sy").select("x", "y")
    within = x.where("sx = 0").join(y.where("sy = 1"), F.col("a") == F.col("b")).select("x", "y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def report(items: DataFrame, least: float = 0.8) -> DataFrame:
    """(split, dataset, n_items, n_overlapping, n_pairs) of the evaluation items, with lower-case trimmed split names."""
    p = pairs(items, least)
    ids = p.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_pairs"))
    split = F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))
    ev = items.select("id", "dataset", split.alias("split")).where(F.col("split").isin(*EVALUATION)).distinct()
    return ev.join(ids, "id", "left").groupBy("split", "dataset").agg(F.count("*").alias("n_items"), F.count("n_pairs").alias("n_overlapping"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"))
