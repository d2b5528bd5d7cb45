"""Mixing sources to target weights of a total size (problem 8).

The wanted size of a mix is size_ratio * (tokens of all documents), shared by target_share.  A source that cannot give
its part, all its documents max_repeats times, is bound: it gives what it has and is marked so.  The others keep their
shares of the wanted size, or with ``fill`` share what is missing in the ratio of their targets.  Each document of a source gets
floor(wanted / available) certain whole copies.  The rest is drawn by Pareto order sampling of fixed size: inclusion odds
pi are proportional to tokens^``power`` and solved so that the expected size of the draw is the rest, with documents
whose odds would pass 1 drawn for certain.  Within classes of about equal size documents are ranked by
U/(1-U) * (1-pi)/pi, U a hash of seed, mix and id, and each class gives a fixed number, its expected number
rounded so that the numbers of all classes add up; so the number of documents is fixed and the size is off by less than
what one document of each class differs from another.  The report has the expected and the actual size.

Ranks are never sorted as a whole: they fall into fixed bins, whole bins are taken by their counts, only the one bin at
the border is sorted.

Defined cases: documents with null or empty text have no size and are not drawn; a null or
unlisted source is in no mix; a mix row with null share counts as 0, with null max_repeats as 1;
repeated rows of one id count once; a listed source without documents is reported with 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.llm import bpe
from claimlake.runtime import cut_lineage

BINS = 1 << 12
#: Size classes an octave.
CLASSES = 8


def sized(documents: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents with an id, once each, in the checkpoint folder."""
    rows = bpe.with_counts(documents.select("doc_id", "source", "text").where("doc_id IS NOT NULL"), vocabulary=vocabulary)
    return cut_lineage(rows.groupBy("doc_id").agg(F.max_by(F.struct("source", "n_tokens"), F.struct("n_tokens", "source")).alias("x")).select("doc_id", "x.source", "x.n_tokens"))


def wanted(rows: list[tuple[float, float]], total: float, fill: bool) -> list[tuple[float, bool]]:
    """(size, bound) of each source, given (share, most it can give): its share of the total, or what it can give if that is less;
    with ``fill`` what bound sources lack goes to the others in the ratio of their shares, as long as one can take it."""
    size = [share * total for share, _ in rows]
    bound = [False] * len(rows)
    while True:
        over = [i for i, (_, most) in enumerate(rows) if not bound[i] and size[i] > most + 1e-9]
        if not over:
            return list(zip(size, bound))
        for i in over:
            size[i], bound[i] = rows[i][1], True
        free = [i for i, b in enumerate(bound) if not b and rows[i][0] > 0]
        if fill and free:
            left = sum(share for share, _ in rows) * total - sum(s for s, b in zip(size, bound) if b)
            for i in free:
                size[i] = left * rows[i][0] / sum(rows[j][0] for j in free)


def plan(sizes: DataFrame, targets: DataFrame, fill: bool) -> DataFrame:
    """One row a (mix, source): target and wanted size, whether bound, whole copies and rest.  As long as the target
    table, which is fixed, and made on the driver from it and one row a source."""
    per = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    t = targets.groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio")).where("source IS NOT NULL")
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    mixes: dict = {}
    for r in t.join(per, "source", "left").orderBy("mix_name", "source").collect():  # rows of the target table
        mixes.setdefault(r["mix_name"], []).append(r)
    out = []
    for name, rows in mixes.items():
        cap = [max(0, 1 if r["max_repeats"] is None else r["max_repeats"]) for r in rows]
        ratio = max((r["size_ratio"] for r in rows if r["size_ratio"] is not None), default=1.0)
        shares = [(r["target_share"] or 0.0, float(c * (r["tokens"] or 0))) for r, c in zip(rows, cap)]
        for r, c, (size, bound) in zip(rows, cap, wanted(shares, ratio * total, fill)):
            tokens = r["tokens"] or 0
            whole = min(c, int((size + 1e-6) // tokens)) if tokens else 0
            rest = size - whole * tokens if whole < c and tokens else 0.0
            out.append((name, r["source"], r["target_share"], (r["target_share"] or 0.0) * ratio * total, size, bound, c, tokens, r["docs"] or 0, whole, rest if rest > 1e-6 * max(1, tokens) else 0.0))
    schema = "mix_name string, source string, target_share double, target_tokens double, want double, bound boolean, cap int, tokens long, docs long, whole int, rest double"
    return sizes.sparkSession.createDataFrame(out, schema)


def odds(sizes: DataFrame, planned: DataFrame, power: float) -> DataFrame:
    """(mix_name, source, scale): pi is min(1, scale * tokens^power), with an expected size of the draw equal to the rest.

    Documents from some size on are certain; the smallest such set whose scale keeps all others at 1 or below is
    found by running sums over the distinct sizes of a source.
    """
    small = F.broadcast(planned.where("rest > 0").select("mix_name", "source", "rest"))  # as long as mix_targets
    by = sizes.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source").orderBy(F.desc("n_tokens"))
    x = F.pow(F.col("n_tokens").cast("double"), F.lit(power))
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("x", x).withColumn("certain", F.coalesce(F.sum(F.col("n_tokens") * F.col("c")).over(above), F.lit(0)))
    by = by.withColumn("weight", F.sum(F.col("n_tokens") * F.col("c") * F.col("x")).over(Window.partitionBy("source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)))
    d = by.join(small, "source").withColumn("scale", (F.col("rest") - F.col("certain")) / F.col("weight")).where("scale > 0 AND scale * x <= 1 + 1e-12")
    return d.groupBy("mix_name", "source").agg(F.max_by("scale", "n_tokens").alias("scale"))


def draw(sizes: DataFrame, planned: DataFrame, power: float, seed: int) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, copies), copies > 0."""
    scale = cut_lineage(odds(sizes, planned, power))
    small = F.broadcast(planned.where("tokens > 0").join(scale, ["mix_name", "source"], "left").select("mix_name", "source", "whole", "scale"))  # as long as mix_targets
    d = sizes.where("n_tokens > 0").join(small, "source")
    u = (F.xxhash64(F.lit(seed), "mix_name", "doc_id").bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    pi = F.when(F.col("scale").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("scale") * F.pow("n_tokens", F.lit(power))))
    d = d.withColumn("u", u).withColumn("pi", F.when(pi > 1 - 1e-12, 1.0).otherwise(pi))
    d = d.withColumn("size_class", F.floor(CLASSES * F.log(2.0, "n_tokens")).cast("int"))
    q = F.col("u") / (1 - F.col("u")) * (1 - F.col("pi")) / F.greatest(F.col("pi"), F.lit(1e-300))
    d = d.withColumn("q", q).withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * BINS), F.lit(BINS - 1)).cast("int"))
    key = ["mix_name", "source", "size_class"]
    some = d.where("pi > 0 AND pi < 1")
    bins = some.groupBy(*key, "bin").agg(F.count("*").alias("c"), F.sum("pi").alias("e"))
    classes = bins.groupBy(*key).agg(F.sum("e").alias("e"))
    # expected numbers rounded along the classes of a source, from the largest documents down
    over = Window.partitionBy("mix_name", "source").orderBy(F.desc("size_class"))
    start = (F.xxhash64(F.lit(seed), "mix_name", "source").bitwiseAND((1 << 20) - 1) + 0.5) / float(1 << 20)
    upto = F.sum("e").over(over.rowsBetween(Window.unboundedPreceding, 0))
    classes = classes.withColumn("take", (F.floor(upto + start + 1e-9) - F.floor(upto - F.col("e") + start + 1e-9)).cast("long"))
    run = F.sum("c").over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # at most BINS rows
    bins = bins.join(classes.select(*key, "take"), key).withColumn("upto", run)
    border = cut_lineage(bins.groupBy(*key).agg(F.first("take").alias("take"), F.min(F.when(F.col("upto") > F.col("take"), F.col("bin"))).alias("border"), F.max(F.when(F.col("upto") <= F.col("take"), F.col("upto"))).alias("below")))
    d = d.join(F.broadcast(border), key, "left")  # one row a mix, source and size class
    edge = d.where("pi > 0 AND pi < 1 AND bin = border")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("q", "doc_id"))
    edge = edge.withColumn("extra", (rank + F.coalesce("below", F.lit(0)) <= F.col("take")).cast("int"))
    inner = d.where("NOT (pi > 0 AND pi < 1 AND border IS NOT NULL AND bin = border)")
    inner = inner.withColumn("extra", F.when(F.col("pi") >= 1, 1).when((F.col("pi") > 0) & (F.col("border").isNull() | (F.col("bin") < F.col("border"))), 1).otherwise(0))
    cols = ("mix_name", "source", "doc_id", "n_tokens", "whole", "extra")
    both = inner.select(*cols).unionByName(edge.select(*cols))
    return both.select("mix_name", "source", "doc_id", "n_tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")).where("copies > 0")


def _share(c: Column) -> Column:
    return F.round(F.try_divide(c, F.sum(c).over(Window.partitionBy("mix_name"))), 6)


def mix(documents: DataFrame, targets: DataFrame, power: float = 0.5, seed: int = 1, fill: bool = False, vocabulary: str = bpe.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(drawn, report): copies of each document per mix; per mix and source target and actual shares, wanted, planned (what a
    bound source can give) and actual sizes, the deviation of the actual from the planned size, and whether the source is bound."""
    sizes = sized(documents, vocabulary)
    planned = plan(sizes, targets, fill)
    drawn = draw(sizes, planned, power, seed)
    got = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("mix_docs"), F.max("copies").alias("most_copies"))
    r = planned.join(got, ["mix_name", "source"], "left").fillna(0, ["mix_tokens", "mix_docs", "most_copies"])
    report = r.select(
        "mix_name", "source", "target_share", _share(F.col("mix_tokens")).alias("actual_share"), F.round("target_tokens", 3).alias("wanted_tokens"), F.round("want", 3).alias("planned_tokens"), "mix_tokens",
        F.round(F.try_divide(F.col("mix_tokens") - F.col("want"), F.col("want")), 6).alias("deviation"), "bound", "mix_docs", "most_copies", F.col("cap").alias("max_repeats"),
    )
    return drawn, report
