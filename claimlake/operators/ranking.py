"""Ranks, samples and running sums that never put one key's rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, keys: list[str], order: Column, out: str = "rank", bits: int = 12) -> DataFrame:
    """Adds the 1-based rank of each row within ``keys`` by ``order``, a hex string such as an md5.

    Rows are ranked within (keys, prefix of the hash) and moved up by the counts of the smaller
    prefixes, so a key of any size is spread over 2^bits groups.  Equal order values are ranked arbitrarily.
    """
    digits = bits // 4
    d = df.withColumn("_o", order).withColumn("_p", F.substring("_o", 1, digits))
    per = d.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = per.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_o")))
    j = d.alias("d").join(before.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_p").alias("_q"), "_before"), (F.col("_p") == F.col("_q")) & _same(keys))
    j = j.withColumn(out, (F.coalesce("_before", F.lit(0)) + F.col("_r")).cast("long"))
    return j.drop("_o", "_p", "_q", "_r", "_before", *(f"_k{i}" for i in range(len(keys))))


def _same(keys: list[str]) -> Column:
    c = F.lit(True)
    for i, k in enumerate(keys):
        c = c & F.col(f"d.{k}").eqNullSafe(F.col(f"_k{i}"))
    return c


def rebalance(df: DataFrame, label: str, key: Column, mode: str, labels: tuple[str, ...]) -> DataFrame:
    """Down: as many rows of each label as the rarest has, by hash order.  Up: rows repeated round-robin to the
    size of the commonest.  Unchanged if any label has no rows."""
    rows = df.where(F.col(label).isin(*labels))
    ranked = hash_rank(rows, [label], F.md5(key.cast("string")))
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    ends = sizes.agg(F.count("*").alias("_labels"), F.min("_size").alias("_min"), F.max("_size").alias("_max"))
    r = ranked.join(F.broadcast(sizes), label).crossJoin(F.broadcast(ends))  # as many rows as labels, and one row
    whole = F.col("_labels") < len(labels)
    if mode == "down":
        out = r.where(whole | (F.col("rank") <= F.col("_min"))).withColumn("copy", F.lit(1))
    else:
        times = F.when(whole, 1).otherwise(F.floor(F.col("_max") / F.col("_size")) + (F.col("rank") <= F.col("_max") % F.col("_size")).cast("int")).cast("int")
        out = r.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return out.drop("_size", "_labels", "_min", "_max", "rank")


def split_share(df: DataFrame, key: Column, share: float) -> DataFrame:
    """Adds ``part``: train for the first floor(share * n) rows (at least one) in hash order, else eval."""
    one = df.withColumn("_all", F.lit(1))
    ranked = hash_rank(one, ["_all"], F.md5(key.cast("string")))
    n = df.agg(F.count("*").alias("_n"))
    r = ranked.crossJoin(F.broadcast(n))  # one row
    return r.withColumn("part", F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share))), "train").otherwise("eval")).drop("_all", "_n", "rank")


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; partial results are merged before the shuffle, so hot keys are no burden."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*order)).alias("_x"))
    return best.select(*keys, *(F.col(f"_x.`{c}`").alias(c) for c in rest))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """Rows ranked up to k within each key, with ``rank``; the group limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
