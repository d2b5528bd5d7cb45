"""Near-duplicate texts: pairs, groups and members (problem 3).

Similarity is the Jaccard coefficient of the sets of ``k``-word sequences.  Steps:

1. texts with the same set are one class (no pair search inside a class);
2. each class gets ``bands`` keys of ``rows`` minimum hashes; a pair of similarity s shares a
   key with probability 1-(1-s^rows)^bands (0.9994 at s=0.7, over 0.99998 at 0.75);
3. classes under one key form a group, compared tile by tile: sorted by population count,
   tile pairs whose counts differ beyond the radius are skipped;
4. every candidate is decided exactly by exclusive-or and bit counts of bit maps over the
   tile's own universe of sequences.

With ``exact`` steps 2 and 3 are :func:`exact_candidates`: all classes as parity sketches, tile against tile by exclusive-or and
bit counts, so that no pair depends on chance; its cost grows with the square of the number of classes.

No group is collected whole: copies are one class per task before the shuffle, a key with very many classes is cut into a
grid first, large groups become tile pairs that are spread over all tasks, and verification streams.

Defined cases: null, empty and shorter than ``k`` words: no class, in no pair; repeated rows of
one id: the id counts once, of different texts one by hash; other columns: ignored; empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.llm import textkit, tiles
from claimlake.runtime import cut_lineage

BANDS, ROWS = 40, 5


def _lowered(column: pa.Array) -> list[str]:
    return [(t or "").lower() for t in column.to_pylist()]


def classes(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, node, n): the class of each text that has at least ``k`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = _lowered(batch["text"])
            node, n = np.zeros(len(low), np.int64), np.zeros(len(low), np.int32)
            for a, b in textkit.blocks(low):
                sets = textkit.shingles(low[a:b], k)
                node[a:b] = textkit.set_hashes(sets)
                n[a:b] = [len(s) for s in sets]
            ok = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([batch["id"].filter(ok), pa.array(node).filter(ok), pa.array(n).filter(ok)], names=["id", "node", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, f"id {kind}, node long, n int")


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """``bands`` 64-bit keys for each non-empty set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    rng = np.random.default_rng(20240229)
    factor = rng.integers(0, 1 << 32, size=(bands, rows, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(sets), bands), np.uint64)
    v, t = np.empty_like(flat), np.empty_like(flat)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            np.multiply(flat, factor[b, r, 0], out=v)
            np.right_shift(v, np.uint32(15), out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, factor[b, r, 1], out=v)
            key = key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, at)
        out[:, b] = textkit.mix64(key)
    return out


def candidates(docs: DataFrame, id_col: str, text_col: str, k: int, least: float, bands: int, rows: int) -> DataFrame:
    """Distinct (a, b) of classes that share a band key and whose sizes allow ``least``."""

    def entries(batch: pa.RecordBatch, seen: set) -> np.ndarray:
        low = _lowered(batch["text"])
        out = []
        for a, b in textkit.blocks(low):
            sets, nodes = [], []
            every = textkit.shingles(low[a:b], k)
            for s, node in zip(every, textkit.set_hashes(every).tolist()):
                if len(s) and node not in seen:
                    seen.add(node)
                    sets.append(s)
                    nodes.append(node)
            if sets:
                e = np.empty((len(sets), bands), tiles.ENTRY)
                e["key"] = band_keys(sets, bands, rows)
                e["node"] = np.array(nodes, np.int64)[:, None]
                e["n"] = np.fromiter((len(s) for s in sets), np.int32, len(sets))[:, None]
                out.append(e.ravel())
        return np.concatenate(out) if out else np.zeros(0, tiles.ENTRY)

    text = docs.select(F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    n = docs.count()
    parts = tiles.parts_for(docs, bands, n)
    blocks = tiles.split_hot(tiles.scatter(text, entries, parts), n, parts)
    return tiles.expand(tiles.gather(blocks, lambda r: tiles.tile_pairs(r, least), "a binary, b binary, crossed boolean", parts), least)


#: Bits of a parity sketch, and classes of a tile of the exact mode.
SKETCH_BITS, EXACT_TILE = 1024, 4096


def _size_bin(n: Column) -> Column:
    """Sizes in steps of a tenth, so that there are few bins whatever the lengths."""
    return F.floor(F.log(1.1, n)).cast("int")


def exact_candidates(docs: DataFrame, id_col: str, text_col: str, k: int, least: float, tile: int = EXACT_TILE) -> DataFrame:
    """(a, b) of all classes whose sketches allow ``least``: a bit of a sketch is the parity of the sequences that fall on it,
    so sets that differ in d sequences have sketches that differ in at most d bits.

    Classes are put into size bins and those into tiles; two tiles meet only if their sizes, the population counts,
    are within the radius.  What comes to the driver is one count a size bin.
    """
    width = SKETCH_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = _lowered(batch["text"])
            for a, b in textkit.blocks(low):
                sets = [s for s in textkit.shingles(low[a:b], k) if len(s)]
                if not sets:
                    continue
                bits = np.zeros((len(sets), SKETCH_BITS), np.uint8)
                for row, s in zip(bits, sets):
                    np.bitwise_xor.at(row, (s % np.uint64(SKETCH_BITS)).astype(np.int64), 1)
                packed = np.packbits(bits, axis=1)
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(textkit.set_hashes(sets)), "n": pa.array([len(s) for s in sets], pa.int32()), "sketch": pa.array([p.tobytes() for p in packed], pa.binary()),
                })

    text = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    every = cut_lineage(text.mapInArrow(run, "node long, n int, sketch binary").dropDuplicates(["node"]).withColumn("bin", _size_bin(F.col("n"))))
    spark = docs.sparkSession
    parts = {r["bin"]: -(-r["c"] // tile) for r in every.groupBy("bin").agg(F.count("*").alias("c")).collect()}
    low, high = (lambda x: 1.1**x), (lambda x: 1.1 ** (x + 1))
    meets = [(x, y, parts[x], parts[y]) for x in parts for y in parts if x <= y and high(x) * (1 + 1e-9) >= least * low(y)]  # rounding of the logarithm
    if not meets:
        return spark.createDataFrame([], "a long, b long")
    m = F.broadcast(spark.createDataFrame(meets, "x int, y int, px int, py int"))  # pairs of size bins
    own = every.withColumn("t", F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int"))
    # a class goes to every tile pair of its tile: as the smaller bin's and as the larger bin's side
    left = own.join(m, F.col("bin") == F.col("x")).withColumn("i", F.col("t") % F.col("px")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("py") - 1))).withColumn("side", F.lit(0))
    right = own.join(m, F.col("bin") == F.col("y")).withColumn("j", F.col("t") % F.col("py")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("px") - 1))).withColumn("side", F.lit(1))
    both = left.select("x", "y", "i", "j", "side", "node", "n", "sketch").unionByName(right.select("x", "y", "i", "j", "side", "node", "n", "sketch")).where("x <> y OR i <= j")

    def meet(table: pa.Table) -> pa.Table:
        side, node, n = (table[c].to_numpy() for c in ("side", "node", "n"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, width)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        y = y[np.argsort(n[y], kind="stable")]
        found = []
        for s in range(0, len(x), 64):
            a = x[s : s + 64]
            lo, hi = np.searchsorted(n[y], [least * n[a].min() - 1e-9, n[a].max() / least + 1e-9])
            b = y[lo:hi]
            apart = np.zeros((len(a), len(b)), np.int32)
            for w in range(width):
                apart += np.bitwise_count(sketch[a, w][:, None] ^ sketch[b, w][None, :])
            p, q = n[a].astype(np.int64)[:, None], n[b].astype(np.int64)[None, :]
            i, j = np.nonzero((apart <= (p + q) * (1 - least) / (1 + least) + 1e-9) & (np.minimum(p, q) >= least * np.maximum(p, q) - 1e-9))
            u, v = node[a[i]], node[b[j]]
            found.append(np.stack((np.minimum(u, v), np.maximum(u, v)))[:, u != v])
        p = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": p[0], "b": p[1]})

    return both.groupBy("x", "y", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8, bands: int = BANDS, rows: int = ROWS, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, node, n), links (a, b, jaccard) between different classes, a < b."""
    members = cut_lineage(classes(docs, id_col, text_col, k).groupBy("id").agg(F.min(F.struct("node", "n")).alias("x")).select("id", "x.node", "x.n"))
    cand = cut_lineage(exact_candidates(docs, id_col, text_col, k, least) if exact else candidates(docs, id_col, text_col, k, least, bands, rows))
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def sets_of(texts: list[str]) -> list[np.ndarray]:
        low = [t.lower() for t in texts]
        return [s for a, b in textkit.blocks(low) for s in textkit.shingles(low[a:b], k)]

    return members, tiles.verify(cand, members, text, sets_of, lambda sets, x, y: tiles.jaccard_pairs(sets, x, y, least), least)


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8, exact: bool = False) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of ids, copies included."""
    members, between = links(docs, id_col, text_col, k, least, exact=exact)
    m = members.select("id", "node")
    x = m.select(F.col("id").alias("x"), F.col("node").alias("a"))
    y = m.select(F.col("id").alias("y"), F.col("node").alias("b"))
    across = between.join(x, "a").join(y, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    several = members.groupBy("node").count().where("count > 1").select("node")
    copies = m.join(several, "node")
    within = copies.select(F.col("id").alias("id_a"), "node").join(copies.select(F.col("id").alias("id_b"), "node"), "node").where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """(id, group_id, n_links) of every text in a group of two or more; group_id is the smallest id of the
    connected component, n_links counts the classes linked to the text's class and its own other copies."""
    members, between = links(docs, id_col, text_col, k, least)
    edges = cut_lineage(between.select("a", "b"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("d")).withColumnRenamed("a", "node")
    label = components(edges)
    per = members.groupBy("node").agg(F.count("*").alias("copies"))
    out = members.join(per, "node").join(degree, "node", "left").join(label, "node", "left").where("copies > 1 OR d IS NOT NULL")
    out = out.select("id", F.coalesce("label", "node").alias("label"), (F.coalesce("d", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    least_id = out.groupBy("label").agg(F.min("id").alias("group_id"))
    return out.join(least_id, "label").select("id", "group_id", "n_links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): connected components by alternating large-star and small-star steps, which end after
    O(log^2 n) rounds whatever the shape; each round is written to the shared checkpoint folder."""
    now = edges.select("a", "b").where("a <> b")
    known = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = cut_lineage(small)
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first()
        if tuple(state) == known:
            break
        known = tuple(state)
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops).distinct()
