"""Knowledge-graph scores: per-query indexes, pair scores, soft triple scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions import scores
from claimlake.operators.linking import entity_pairs
from claimlake.operators.ranking import top_k
from claimlake.operators.retrieval import nearest


def index(rows: DataFrame, key: str = "query_id", score: Column | None = None, node: str = "node_hit", pair: str = "pair_hit", agg: str = "max", k: int = 10, hit_only: bool = False, missing_hit: bool = False) -> DataFrame:
    """One row a query: n_rows, n_node_hit, n_pair_hit, max_score (at least 0), score, hit, hit_type.

    ``agg`` max takes the largest score (with ``hit_only`` the best hit, which may be negative), mean_topk the
    mean of the best k kept rows, 0 if none.  Missing scores count as 0, missing flags as ``missing_hit``.
    """
    s = scores.safe_double(score if score is not None else F.col("p_final"))
    r = rows.where(F.col(key).isNotNull()).select(key, s.alias("s"), F.coalesce(node, F.lit(missing_hit)).alias("n"), F.coalesce(pair, F.lit(missing_hit)).alias("p"))
    kept = F.col("n") | F.col("p") if hit_only else F.lit(True)
    base = r.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if("n").alias("n_node_hit"), F.count_if("p").alias("n_pair_hit"), F.greatest(F.lit(0.0), F.max("s")).alias("max_score"), F.max(F.when(kept, F.col("s"))).alias("_best"))
    if agg == "max":
        value = F.coalesce("_best", "max_score") if hit_only else F.col("max_score")
    elif agg == "mean_topk":
        top = top_k(r.where(kept), [key], k, F.desc("s")).groupBy(key).agg(F.avg("s").alias("_mean"))
        base = base.join(top, key, "left")
        value = F.coalesce("_mean", F.lit(0.0))
    else:
        raise ValueError(f"unknown aggregation {agg!r}")
    kind = F.when(F.col("n_pair_hit") > 0, "pair").when(F.col("n_node_hit") > 0, "node").otherwise("none")
    return base.select(key, "n_rows", "n_node_hit", "n_pair_hit", "max_score", value.alias("score"), ((F.col("n_node_hit") > 0) | (F.col("n_pair_hit") > 0)).alias("hit"), kind.alias("hit_type"))


def file_stats(rows: DataFrame, score: str, node: str, pair: str) -> DataFrame:
    """One row of diagnostics; missing scores count as 0 in the range."""
    s = scores.safe_double(F.col(score))
    return rows.agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("query_id").isNull()).alias("n_missing_qid"), F.count_if(F.col(score).isNull()).alias("n_missing_score"),
        F.min(F.when(F.col("query_id").isNotNull(), s)).alias("score_min"), F.max(F.when(F.col("query_id").isNotNull(), s)).alias("score_max"),
        F.count_if(F.col("query_id").isNotNull() & (s > 0)).alias("score_gt0"), F.count_if(F.coalesce(node, F.lit(False)) | F.coalesce(pair, F.lit(False))).alias("n_hit_true"),
    )


def calibrated(rows: DataFrame, score: str, method: str, scope: list[str] | None = None) -> DataFrame:
    """``rows`` with ``calibrated``; bounds come from all rows or from each ``scope`` (a file column, say)."""
    scope = scope or []
    bounds = rows.groupBy(*scope).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    j = rows.join(bounds, scope) if scope else rows.crossJoin(F.broadcast(bounds))  # one row without scope
    return j.withColumn("calibrated", scores.calibrate(F.col(score), method, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def pair_scores(groups: DataFrame, key: str, ids: str, vectors: DataFrame, eid: str, vec: str, most: int | None) -> DataFrame:
    """(key, a, b, dist, score) of the entity pairs i < j of each group's id array; ids without a vector are in no pair."""
    v = vectors.select(F.col(eid).alias("e"), F.col(vec).alias("v"))
    p = groups.select(key, F.explode(entity_pairs(F.col(ids), most)).alias("p")).select(key, "p.a", "p.b")
    j = p.join(v.select(F.col("e").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("e").alias("b"), F.col("v").alias("vb")), "b")
    d = j.withColumn("dist", scores.distance(F.col("va"), F.col("vb")))
    return d.select(key, "a", "b", "dist", (1 / (1 + F.col("dist"))).alias("score"))


def claim_scores(pairs: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(key, mean_top, best, pair_hit): mean of the best k pair scores and the largest one."""
    top = top_k(pairs, [key], k, F.desc("score")).groupBy(key).agg(F.avg("score").alias("mean_top"))
    best = pairs.groupBy(key).agg(F.max("score").alias("best"))
    return top.join(best, key).withColumn("pair_hit", F.lit(True))


def centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, vec ARRAY<DOUBLE>): mean vector of each group, not normalised."""
    e = vectors.select(group, F.posexplode(vec).alias("i", "x"))
    m = e.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))  # one entry a dimension


def entity_candidates(claims: DataFrame, claim: str, vec: str, aliases: DataFrame, kind: str, entity: str, avec: str, k: int) -> DataFrame:
    """(claim, kind, entity, sim, rank): per claim and entity type the k entities whose best alias is nearest, at least 0."""
    met = nearest(claims, claim, vec, aliases, entity, avec, k, kind)
    met = met.select(claim, F.col("kind").cast(aliases.schema[kind].dataType).alias(kind), entity, F.greatest(F.lit(0.0), "score").alias("sim"))
    return top_k(met, [claim, kind], k, F.desc(F.round("sim", 9)), F.asc(entity))


def best_triple(candidates: DataFrame, claim: str, score: str, *order: Column) -> DataFrame:
    """The candidate with the strictly largest score of each claim; of equal ones the first in ``order``."""
    w = Window.partitionBy(claim).orderBy(F.desc(F.round(score, 9)), *order)
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
