"""Lexical, dense and hybrid retrieval, and rank fusion."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions import text
from claimlake.operators.ranking import top_k
from claimlake.runtime import cut_lineage

if TYPE_CHECKING:
    import numpy as np


def _tokens(corpus: DataFrame, key: str, content: str) -> DataFrame:
    return corpus.where(F.col(key).isNotNull()).select(key, text.bm25_tokens(F.coalesce(F.col(content), F.lit(""))).alias("_t"))


def postings(corpus: DataFrame, key: str, content: str, only: DataFrame | None = None) -> DataFrame:
    """(token, key, tf, dl): term frequencies and document lengths, of the tokens of ``only`` (a column token) if given.

    The filter comes before the aggregation, so what is shuffled is the postings of the asked tokens."""
    each = _tokens(corpus, key, content).select(key, F.size("_t").alias("dl"), F.explode("_t").alias("token"))
    if only is not None:
        each = each.join(only.select("token").distinct(), "token", "left_semi")
    return each.groupBy("token", key, "dl").agg(F.count("*").alias("tf"))


def lengths(corpus: DataFrame, key: str, content: str) -> DataFrame:
    """One row (n_docs, avgdl) over all documents, empty ones included."""
    return corpus.where(F.col(key).isNotNull()).agg(F.count("*").alias("n_docs"), F.avg(F.size(text.bm25_tokens(F.coalesce(F.col(content), F.lit(""))))).alias("avgdl"))


def statistics(corpus: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """((token, df), one row (n_docs, avgdl)) of one reading of the corpus, kept in the checkpoint folder: each document counts a
    token once, and adds its length under no token, so both are merged before the shuffle."""
    none = F.struct(F.lit(None).cast("string").alias("token"), F.size("_t").cast("long").alias("dl"))
    each = F.concat(F.transform(F.array_distinct("_t"), lambda x: F.struct(x.alias("token"), F.lit(0).cast("long").alias("dl"))), F.array(none))
    g = cut_lineage(_tokens(corpus, key, content).select(F.inline(each)).groupBy("token").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")))
    stats = g.where("token IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_docs"), F.try_divide(F.sum("dl"), F.sum("df")).alias("avgdl"))
    return g.where("token IS NOT NULL").select("token", "df"), stats


def idf(frequencies: DataFrame, stats: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(token, df, idf); negative values become ``epsilon`` times the mean over all tokens."""
    raw = frequencies.crossJoin(F.broadcast(stats)).withColumn("idf", F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))  # stats is one row
    mean = raw.agg(F.avg("idf").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))  # one row


#: Rows of a query table up to which it is sent to all tasks; beyond, the join is salted.
SENT = 1_000_000
SALTS = 16


def bm25(queries: DataFrame, qkey: str, qtext: str, corpus: DataFrame, key: str, content: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qkey, key, score, rank): Okapi top k of each query.  Repeated query tokens count each time; documents that
    share no token with a query are no hits.  Equal query texts are scored once.

    The corpus is read twice: once for its statistics, once against the asked tokens with their weights.  These are sent
    to the tasks if they are at most SENT; else both sides carry a salt, so that the occurrences of a common
    token are spread over SALTS tasks.  Only occurrences of asked tokens are shuffled, by query and document.
    """
    frequencies, stats = statistics(corpus, key, content)
    weights = idf(frequencies, stats)
    toks = queries.select(qkey, text.bm25_tokens(F.coalesce(F.col(qtext), F.lit(""))).alias("_t"))
    asked = toks.select(F.array_sort("_t").alias("_a")).distinct().withColumn("_q", F.xxhash64("_a")).select("_q", F.explode("_a").alias("token")).groupBy("_q", "token").agg(F.count("*").alias("qn"))
    w = cut_lineage(asked.join(weights.select("token", "idf"), "token").crossJoin(F.broadcast(stats.select("avgdl"))))  # one row
    d = _tokens(corpus, key, content).select(key, F.size("_t").alias("dl"), F.explode("_t").alias("token"))
    if w.count() <= SENT:
        p = d.join(F.broadcast(w), "token")  # at most SENT rows
    else:
        salted = w.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = d.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["token", "_s"])
    # occurrences go to the task of their query and document, where both groupings find them
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tf = p.repartition(n, "_q", key).groupBy("_q", key, "token").agg(F.count("*").alias("tf"), *(F.first(c).alias(c) for c in ("dl", "qn", "idf", "avgdl")))
    part = F.col("qn") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.groupBy("_q", key).agg(F.sum(part).alias("score"))
    best = top_k(scored, ["_q"], k, F.desc(F.round("score", 6)), F.asc(key))
    return toks.select(qkey, F.xxhash64(F.array_sort("_t")).alias("_q")).join(best, "_q").select(qkey, key, "score", "rank")


class Best:
    """The k best keys of each query and kind so far, fed with score matrices; equal scores go to the smaller key."""

    def __init__(self, k: int):
        self.k = k
        self.rows: tuple | None = None

    def feed(self, scores_: "np.ndarray", keys: "np.ndarray", kinds: "np.ndarray") -> None:
        """``scores_`` has a row a query and a column a key; a key may come more than once, its best score counts."""
        import numpy as np

        order = np.lexsort((keys, kinds))
        keys, kinds, scores_ = keys[order], kinds[order], scores_[:, order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])])
        if len(first) < len(keys):
            scores_ = np.maximum.reduceat(scores_, first, axis=1)
            keys, kinds = keys[first], kinds[first]
        cut = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True])
        parts = [] if self.rows is None else [self.rows]
        for a, z in zip(cut[:-1], cut[1:]):
            s = scores_[:, a:z]
            r = np.round(s, 9)
            if z - a > self.k:
                least = np.partition(r, z - a - self.k, axis=1)[:, z - a - self.k]
                q, c = np.nonzero(r >= least[:, None])
            else:
                q, c = np.nonzero(np.ones_like(r, bool))
            parts.append((q, kinds[a + c], keys[a + c], s[q, c]))
        q, kind, key, s = (np.concatenate(x) for x in zip(*parts))
        # the best score of each key, then the first k of each query and kind
        o = np.lexsort((-s, key, kind, q))
        q, kind, key, s = q[o], kind[o], key[o], s[o]
        new = np.r_[True, (q[1:] != q[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])] if len(q) else np.zeros(0, bool)
        q, kind, key, s = q[new], kind[new], key[new], s[new]
        o = np.lexsort((key, -np.round(s, 9), kind, q))
        q, kind, key, s = q[o], kind[o], key[o], s[o]
        start = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (kind[1:] != kind[:-1])]) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        keep = place < self.k
        self.rows = (q[keep], kind[keep], key[keep], s[keep])


def matrix(column, dim: int | None = None):
    """The vectors of an Arrow list column as one matrix of doubles."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if dim is None else dim) if len(column) else np.zeros((0, dim or 0))


#: Bytes of query vectors that are sent to all tasks at most; and rows of either side of a meeting beyond that.
SENT_BYTES = 64 << 20
MEETING = 16_384


def nearest(queries: DataFrame, qkey: str, qvec: str, corpus: DataFrame, key: str, vec: str, k: int, kind: str | None = None) -> DataFrame:
    """(qkey, kind, key, score): candidates among which are the exact k best keys of each query (and kind), by the best
    inner product of a key's vectors.  Null vectors are left out.

    Query vectors of at most SENT_BYTES, measured, are sent to the tasks and the corpus streams past them without a
    shuffle, batch by batch as one matrix product; only each task's own best leave it.  More queries meet the
    corpus in blocks of MEETING rows of each side, whose number follows from counts.
    """
    import numpy as np
    import pyarrow as pa

    kt, qt = corpus.schema[key].dataType.simpleString(), queries.schema[qkey].dataType.simpleString()
    q = queries.where(F.col(qvec).isNotNull()).select(F.col(qkey).alias("q"), F.col(qvec).cast("array<double>").alias("v"))
    c = corpus.where(F.col(vec).isNotNull()).select((F.col(kind).cast("string") if kind else F.lit("")).alias("kind"), F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"))
    schema = f"q {qt}, kind string, k {kt}, score double"
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("cells")).first()

    def rows(best: Best, ids: pa.Array, ktype: pa.DataType) -> pa.RecordBatch:
        a, kd, ky, s = best.rows
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), pa.array(kd, pa.string()), pa.array(ky, ktype), pa.array(s)], names=["q", "kind", "k", "score"])

    def add(best: Best, vectors, b) -> None:
        v = matrix(b["v"], vectors.shape[1])
        best.feed(vectors @ v.T, np.array(b["k"].to_pylist()), np.array(b["kind"].to_pylist(), dtype=object).astype(str))

    if size["cells"] * 8 <= SENT_BYTES:
        held = q.toArrow().combine_chunks()  # at most SENT_BYTES
        shared = queries.sparkSession.sparkContext.broadcast((held["q"].combine_chunks() if size["n"] else pa.array([]), matrix(held["v"]) if size["n"] else np.zeros((0, 0))))

        def stream(batches):
            ids, vectors = shared.value
            best = Best(k)
            kind_of = None
            for whole in batches:
                for o in range(0, whole.num_rows, MEETING // 4):
                    b = whole.slice(o, MEETING // 4)
                    if len(ids) and b.num_rows:
                        kind_of = b["k"].type
                        add(best, vectors, b)
            if best.rows is not None:
                yield rows(best, ids, kind_of)

        met = c.mapInArrow(stream, schema)
    else:
        nq, nc = -(-size["n"] // MEETING), max(1, -(-c.count() // MEETING))
        qs = q.withColumn("_b", F.pmod(F.xxhash64("q"), F.lit(nq))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
        # the vectors of a key may be in several blocks: each block's best hold the best of all
        cs = c.withColumn("_s", F.pmod(F.xxhash64("k", "v"), F.lit(nc)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))

        def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
            left, right = left.combine_chunks(), right.combine_chunks()
            best = Best(k)
            ids = left["q"].combine_chunks() if left.num_rows else pa.array([], left["q"].type)
            if left.num_rows and right.num_rows:
                add(best, matrix(left["v"]), right)
                return pa.Table.from_batches([rows(best, ids, right["k"].type)])
            return pa.table({"q": ids.slice(0, 0), "kind": pa.array([], pa.string()), "k": pa.array([], right["k"].type), "score": pa.array([], pa.float64())})

        met = qs.groupBy("_b", "_s").cogroup(cs.groupBy("_b", "_s")).applyInArrow(meet, schema)
    return met.groupBy("q", "kind", "k").agg(F.max("score").alias("score")).select(F.col("q").alias(qkey), "kind", F.col("k").alias(key), "score")


def dense(queries: DataFrame, qkey: str, qvec: str, corpus: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """(qkey, key, score, rank): exact inner-product top k of each query against the whole corpus, see :func:`nearest`."""
    return top_k(nearest(queries, qkey, qvec, corpus, key, vec, k).drop("kind"), [qkey], k, F.desc(F.round("score", 9)), F.asc(key))


def normalised(hits: DataFrame, qkey: str, out: str) -> DataFrame:
    """Scores between 0 and 1 within each query; ranges under 1e-8 give 0."""
    w = Window.partitionBy(qkey)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn(out, F.when(hi - lo < 1e-8, 0.0).otherwise((F.col("score") - lo) / (hi - lo)))


def hybrid(dense_hits: DataFrame, lexical_hits: DataFrame, qkey: str, key: str, alpha: float, k: int) -> DataFrame:
    """(qkey, key, dense, lexical, score, rank): weighted sum of both normalised legs, 0 where a leg has no hit."""
    d = normalised(dense_hits, qkey, "dense").select(qkey, key, "dense")
    s = normalised(lexical_hits, qkey, "lexical").select(qkey, key, "lexical")
    j = d.join(s, [qkey, key], "full").fillna(0.0, ["dense", "lexical"])
    return top_k(j.withColumn("score", alpha * F.col("dense") + (1 - alpha) * F.col("lexical")), [qkey], k, F.desc(F.round("score", 6)), F.asc(key))


def reciprocal_rank(runs: DataFrame, qkey: str, key: str, k: int, k_rrf: float = 60.0) -> DataFrame:
    """(qkey, key, rrf_score, score, rank) of runs (qkey, key, score, rank from 1, weight, run_no).

    Each appearance adds weight / (k_rrf + rank); the first hit seen keeps its own score.
    """
    seen = F.struct("run_no", "rank")
    f = runs.groupBy(qkey, key).agg(F.sum(F.col("weight") / (k_rrf + F.col("rank"))).alias("rrf_score"), F.min_by("score", seen).alias("score"), F.min(seen).alias("_first"))
    return top_k(f, [qkey], k, F.desc(F.round("rrf_score", 9)), F.asc("_first"), F.asc(key)).drop("_first")


def weights(spec: str) -> dict[str, float]:
    """Run weights of a specification such as gold=1.0,dense=1.2."""
    pairs = (p.split("=", 1) for p in spec.split(",") if "=" in p)
    return {k.strip(): float(v) for k, v in pairs}


def weight_column(spec: Column, run: Column) -> Column:
    """Weight of a run in a specification column; 1 if it is not named."""
    return F.coalesce(F.try_element_at(F.str_to_map(spec, F.lit(","), F.lit("=")), run).cast("double"), F.lit(1.0))


def hits_to_rows(hits: DataFrame, qkey: str, key: str, docs: DataFrame, content: str, title: str, source: str) -> DataFrame:
    """Nested hit list of each query: retrieved_context ARRAY<STRUCT<doc_id, text, title, score, source>> in rank order."""
    d = docs.select(key, F.col(content).alias("_c"), F.col(title).alias("_t"), F.col(source).alias("_s"))
    h = hits.join(d, key)
    item = F.struct("rank", F.struct(F.col(key).cast("string").alias("doc_id"), F.coalesce("_c", F.lit("")).alias("text"), F.coalesce("_t", F.lit("")).alias("title"), "score", F.coalesce("_s", F.lit("")).alias("source")).alias("hit"))
    return h.groupBy(qkey).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["hit"]).alias("retrieved_context"))  # at most k hits a query


def near_vectors(vectors: DataFrame, key: str, vec: str, least: float = 0.95, exact: bool = False, bands: int = 24, bits: int = 12, tile: int = 2048) -> DataFrame:
    """(a, b, cosine), a < b: pairs of unit vectors with cosine at least ``least``.

    Candidates share one of ``bands`` keys of ``bits`` signs of random projections; a pair at angle t does so with
    probability 1 - (1 - (1 - t/pi)^bits)^bands: 0.9996 at cosine 0.95, 0.89 at 0.8.  Within a key, vectors are cut into
    tiles, and two tiles meet as one matrix product, wherever there is room; so a key that holds a third of all rows is many
    work items.  ``exact`` compares all tiles of the table instead: every pair, with cost growing with the square.
    """
    import numpy as np
    import pyarrow as pa

    kt = vectors.schema[key].dataType.simpleString()
    v = vectors.where(F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    if exact:
        keyed = v.select(F.lit(0).cast("long").alias("key"), "id", "v")
    else:
        def sign(batches):
            planes = None
            for b in batches:
                if not b.num_rows:
                    continue
                m = matrix(b["v"])
                if planes is None:
                    planes = np.random.default_rng(20240229).standard_normal((bands * bits, m.shape[1]))
                s = (m @ planes.T > 0).reshape(len(m), bands, bits)
                keys = (s << np.arange(bits)).sum(axis=2) + (np.arange(bands) << bits)
                for j in range(bands):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, j].astype(np.int64)), b["id"], b["v"]], names=["key", "id", "v"])

        keyed = v.mapInArrow(sign, f"key long, id {kt}, v array<double>")
    keyed = cut_lineage(keyed)
    # a key of n rows has ceil(n / tile) tiles; each tile pair is one group of two tiles
    tiles = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
    d = keyed.join(tiles, "key").withColumn("t", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("t", o).alias("i"), F.greatest("t", o).alias("j")))
    d = d.select("key", "t", "id", "v", F.explode(pair).alias("p")).select("key", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "t", "id", "v")

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        m, t = matrix(table["v"]), table["t"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        x, y = (np.flatnonzero(t == i), np.flatnonzero(t == j))
        s = m[x] @ m[y].T
        a, b = np.nonzero(s >= least - 1e-12)
        ids = table["id"].combine_chunks()
        left, right = ids.take(pa.array(x[a])), ids.take(pa.array(y[b]))
        return pa.table({"a": left, "b": right, "cosine": pa.array(s[a, b])})

    met = d.groupBy("key", "i", "j").applyInArrow(meet, f"a {kt}, b {kt}, cosine double").where("a <> b")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("cosine"))
