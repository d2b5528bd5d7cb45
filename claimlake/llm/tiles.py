"""Numpy blocks as Spark rows, and tiled pair search in them.

Posting lists of millions of (key, node) entries travel as binary blocks, one row per
target part and block, so that the JVM moves few large rows instead of many small ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm import textkit
from claimlake.runtime import cut_lineage

ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<i4")])
TILE = 256
#: Entries that a task keeps before it writes them out as blocks.
FLUSH = 1 << 18


def scatter(df: DataFrame, entries: Callable[[pa.RecordBatch, set], np.ndarray], parts: int) -> DataFrame:
    """Rows (part, block): the ENTRY records of each batch, cut by key into ``parts``.

    ``entries(batch, seen)`` may use the task's own ``seen`` set to give each node once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        kept: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(kept)
            part = (rows["key"] % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            return pa.RecordBatch.from_pydict(
                {"part": pa.array(part[cut[:-1]], pa.int32()), "block": pa.array([rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())}
            )

        for batch in batches:
            e = entries(batch, seen)
            if len(e):
                kept.append(e)
                size += len(e)
            if len(seen) > 1 << 20:
                seen.clear()  # only a saving: whatever comes twice is dropped later
            if size >= FLUSH:
                yield flush()
                kept, size = [], 0
        if kept:
            yield flush()

    return df.mapInArrow(run, "part int, block binary")


#: Entries of one key that are gathered by one task at most.
HOT = 500_000


def split_hot(blocks: DataFrame, rows: int, parts: int, entry: np.dtype = ENTRY, limit: int | None = None) -> DataFrame:
    """``blocks`` as (part, cell, block), the entries of keys with more than ``limit`` (HOT) entries cut into a grid.

    A key has at most one entry a row of the input, so up to ``limit`` rows there is nothing to cut.  Beyond, the blocks
    are written down and keys counted in them: a key over the limit in F flushes has most of its entries in flushes that hold at
    least limit/4F of it, so only such counts are added up.  The hot keys are at most as many as fit their entries in all
    blocks, a few a part.  Each is cut into s pieces by node, and each pair of pieces is a cell that any task can take.
    """
    limit = limit or HOT
    if rows <= limit:
        return blocks.select("part", F.lit(-1).cast("long").alias("cell"), "block")
    held = cut_lineage(blocks)
    flushes = max(1, held.groupBy("part").count().agg(F.max("count")).first()[0] or 1)
    least = max(1, limit // (4 * flushes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["block"].to_pylist():
                key, n = np.unique(np.frombuffer(block, entry)["key"], return_counts=True)
                big = n >= least
                yield pa.RecordBatch.from_pydict({"key": pa.array(key[big].view(np.int64)), "n": pa.array(n[big].astype(np.int64))})

    found = held.select("block").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > 0.75 * limit).collect()
    if not found:
        return held.select("part", F.lit(-1).cast("long").alias("cell"), "block")
    pieces = {r["key"] & ((1 << 64) - 1): -(-2 * r["n"] // limit) for r in found}
    hot = np.array(sorted(pieces), np.uint64)
    first = np.cumsum([0, *(pieces[int(k)] ** 2 for k in hot[:-1])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in zip(batch["part"].to_pylist(), batch["block"].to_pylist()):
                e = np.frombuffer(block, entry)
                at = np.minimum(np.searchsorted(hot, e["key"]), len(hot) - 1)
                is_hot = hot[at] == e["key"]
                out = [(part, -1, e[~is_hot].tobytes())] if not is_hot.all() else []
                for h in np.unique(at[is_hot]):
                    own = e[is_hot & (at == h)]
                    s = pieces[int(hot[h])]
                    sub = (textkit.mix64(own["node"].view(np.uint64)) % np.uint64(s)).astype(np.int64)
                    for i in np.unique(sub):
                        piece = own[sub == i].tobytes()
                        for j in range(s):
                            cell = int(first[h]) + min(i, j) * s + max(i, j)
                            out.append((int(textkit.mix64(np.array([cell], np.uint64))[0] % np.uint64(parts)), cell, piece))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["part", "cell", "block"])

    return held.mapInArrow(cut, "part int, cell long, block binary")


def gather(blocks: DataFrame, reduce: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str, parts: int, entry: np.dtype = ENTRY) -> DataFrame:
    """``reduce`` of all entries of each (part, cell); a part is bounded by the choice of ``parts``, a cell by :func:`split_hot`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None
        for batch in batches:
            for part, cell, block in zip(batch["part"].to_pylist(), batch["cell"].to_pylist(), batch["block"].to_pylist()):
                if (part, cell) != at and held:
                    yield from reduce(np.frombuffer(b"".join(held), entry))
                    held = []
                at = (part, cell)
                held.append(block)
        if held:
            yield from reduce(np.frombuffer(b"".join(held), entry))

    # parts are even by their hash; a part number is a partition number, so that none gets several
    return blocks.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "cell").mapInArrow(run, schema)


def tile_pairs(rows: np.ndarray, ratio: float) -> Iterator[pa.RecordBatch]:
    """Work items (a, b, crossed) for all pairs of nodes that share a key and may reach the size ratio.

    Groups up to TILE come as aligned pair blocks.  A larger group is sorted by size (its
    population count) and cut into tiles; two tiles whose counts differ beyond the radius are
    skipped, each other tile pair is one crossed item that any task can expand.
    """
    order = np.lexsort((rows["node"], rows["key"]))
    rows = rows[order]
    same = (rows["key"][1:] == rows["key"][:-1]) & (rows["node"][1:] == rows["node"][:-1])
    rows = rows[np.r_[True, ~same]]
    key = rows["key"]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    begin, size = cut[:-1], np.diff(cut)
    left, right = [], []
    for g in np.unique(size[(size > 1) & (size <= TILE)]):
        b = begin[size == g]
        i, j = np.triu_indices(g, 1)
        step = max(1, (1 << 20) // len(i))
        for s in range(0, len(b), step):
            x, y = (b[s : s + step, None] + i).ravel(), (b[s : s + step, None] + j).ravel()
            nx, ny = rows["n"][x], rows["n"][y]
            ok = np.minimum(nx, ny) >= ratio * np.maximum(nx, ny) - 1e-9
            p = np.stack((rows["node"][x[ok]], rows["node"][y[ok]]))
            p = np.unique(np.sort(p, axis=0), axis=1)
            left.append(p[0])
            right.append(p[1])
            if sum(map(len, left)) > 1 << 20:
                yield _items(left, right)
                left, right = [], []
    if left:
        yield _items(left, right)
    for b, g in zip(begin[size > TILE], size[size > TILE]):
        group = rows[b : b + g]
        group = group[np.argsort(group["n"], kind="stable")]
        tiles = [group[s : s + TILE] for s in range(0, g, TILE)]
        for i, x in enumerate(tiles):
            for y in tiles[i:]:
                if x["n"][-1] < ratio * y["n"][0] - 1e-9:
                    break  # sorted by count: later tiles differ even more
                yield pa.RecordBatch.from_pydict({"a": pa.array([x.tobytes()], pa.binary()), "b": pa.array([y.tobytes()], pa.binary()), "crossed": [True]})


def _items(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.stack((np.concatenate(left), np.concatenate(right))), axis=1)
    step = 1 << 14
    at = range(0, p.shape[1], step) if p.shape[1] else []
    return pa.RecordBatch.from_pydict(
        {"a": pa.array([p[0, s : s + step].tobytes() for s in at], pa.binary()), "b": pa.array([p[1, s : s + step].tobytes() for s in at], pa.binary()), "crossed": pa.array([False for _ in at], pa.bool_())}
    )


def expand(items: DataFrame, ratio: float) -> DataFrame:
    """Distinct (a, b), a < b, of the work items, which are spread over all tasks first; of crossed tiles only the pairs whose
    counts may reach the ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, crossed in zip(*(batch[c].to_pylist() for c in ("a", "b", "crossed"))):
                if crossed:
                    e, f = np.frombuffer(a, ENTRY), np.frombuffer(b, ENTRY)
                    n, m = e["n"][:, None], f["n"][None, :]
                    i, j = np.nonzero(np.minimum(n, m) >= ratio * np.maximum(n, m) - 1e-9)
                    x, y = e["node"][i], f["node"][j]
                else:
                    x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                lo, hi = np.minimum(x, y), np.maximum(x, y)
                ok = lo < hi
                yield pa.RecordBatch.from_pydict({"a": pa.array(lo[ok]), "b": pa.array(hi[ok])})

    return items.repartition(max(2, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, "a long, b long").distinct()


#: Partners of a node that are settled in one stream.
SPLIT = 4096


def verify(cand: DataFrame, members: DataFrame, texts: DataFrame, sets_of: Callable[[list[str]], list[np.ndarray]], decide: Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray], least: float) -> DataFrame:
    """(a, b, jaccard) of the candidate pairs (a, b) of nodes that reach ``least``.

    ``members`` (id, node) and ``texts`` (id, text) give the text of one member of each node; of several texts of
    an id only those of the node itself count.  Rows travel to the block of the smaller node and stream
    there in tiles, whose pairs ``decide`` settles exactly; a node with more than SPLIT partners has several blocks.
    """
    first = members.groupBy("node").agg(F.min("id").alias("id"))
    many = cand.groupBy("a").agg(F.count("*").alias("_c")).where(F.col("_c") > SPLIT).select("a", F.ceil(F.col("_c") / SPLIT).alias("_s"))
    salted = cand.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("_s")), F.lit(0)).alias("salt"))
    wanted = salted.select(F.col("a").alias("block"), "salt", F.col("b").alias("node"), F.lit(1).alias("place")).unionByName(
        salted.select(F.col("a").alias("block"), "salt", F.col("a").alias("node"), F.lit(0).alias("place")).distinct()
    )
    placed = wanted.join(first, "node").join(texts, "id").select("block", "salt", "place", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple[int, np.ndarray] | None = None
        for batch in batches:
            for o in range(0, batch.num_rows, TILE):
                part = batch.slice(o, TILE)
                block, place, node = (part[c].to_numpy() for c in ("block", "place", "node"))
                sets = sets_of(part["text"].to_pylist())
                own = (textkit.set_hashes(sets) == node) & (np.fromiter(map(len, sets), np.int64, len(sets)) > 0)
                at: dict[int, int] = {}
                if head is not None:
                    at[head[0]] = len(sets)
                    sets.append(head[1])
                for i in np.flatnonzero(own & (place == 0)):
                    at[int(block[i])] = int(i)
                other = np.flatnonzero(own & (place == 1))
                left = np.fromiter((at[int(x)] for x in block[other]), np.int64, len(other))
                j = decide(sets, left, other)
                ok = j >= least - 1e-9
                yield pa.RecordBatch.from_pydict({"a": pa.array(block[other][ok]), "b": pa.array(node[other][ok]), "jaccard": pa.array(j[ok])})
                last = int(block[-1])
                head = (last, sets[at[last]]) if last in at else None

    n = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "block", "salt").sortWithinPartitions("block", "salt", "place").mapInArrow(run, "a long, b long, jaccard double").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def bitmaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bit maps of the sets over their common universe, as rows of 64-bit words, and their population counts."""
    count = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    universe, place = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    width = -(-max(1, len(universe)) // 64) * 64
    bits = np.zeros((len(sets), width), bool)
    bits[np.repeat(np.arange(len(sets)), count), place] = True
    return np.packbits(bits, axis=1).view(np.uint64), count


def jaccard_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Exact Jaccard of the index pairs by exclusive-or and bit counts; 0 where the counts alone rule the pair out."""
    maps, count = bitmaps(sets)
    na, nb = count[left], count[right]
    out = np.zeros(len(left))
    ok = np.flatnonzero((np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9) & (na > 0))
    step = max(1, (1 << 22) // max(1, maps.shape[1] * 8))
    for s in range(0, len(ok), step):
        at = ok[s : s + step]
        apart = np.bitwise_count(maps[left[at]] ^ maps[right[at]]).sum(axis=1, dtype=np.int64)
        total = na[at] + nb[at]
        out[at] = (total - apart) / (total + apart)
    return out


def parts_for(df: DataFrame, entries_per_row: int, rows: int) -> int:
    """Parts of at most about two million entries."""
    at_least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(at_least, -(-rows * entries_per_row // 2_000_000))
