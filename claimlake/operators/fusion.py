"""Fusing claim probabilities with graph scores, and summaries of fused claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions import scores
from claimlake.operators import accessors
from claimlake.operators.ranking import top_k


def probabilities(claims: DataFrame, nli: str = "nli") -> DataFrame:
    """``claims`` with pe, pn, pc; null members count as 0."""
    g = lambda k: scores.safe_double(F.col(f"{nli}.{k}"))
    return claims.withColumns({"pe": g("p_entailed"), "pn": g("p_neutral"), "pc": g("p_contradicted")})


def attach(claims: DataFrame, index: DataFrame, key: str = "query_id") -> DataFrame:
    """Left join of the per-query graph index; claims of unknown queries get score 0 and no hit."""
    j = claims.join(index.select(key, F.col("score").alias("kg_raw"), F.col("hit").alias("kg_hit"), F.col("hit_type").alias("kg_hit_type")), key, "left")
    return j.withColumns({"kg_raw": F.coalesce("kg_raw", F.lit(0.0)), "kg_hit": F.coalesce("kg_hit", F.lit(False)), "kg_hit_type": F.coalesce("kg_hit_type", F.lit("none"))})


def fuse(claims: DataFrame, beta: float = 0.8, score: Column | None = None) -> DataFrame:
    """``claims`` (pe, pn, pc, kg_raw, kg_hit) with kg_score, fe, fn, fc and fused_label.

    The graph score only counts where there is a hit; elsewhere the raw probabilities stay as they are.
    """
    s = scores.clamp(score if score is not None else F.col("kg_raw"))
    c = claims.withColumn("kg_score", F.when(F.col("kg_hit"), s).otherwise(0.0))
    c = c.withColumn("_f", scores.fuse_logit(F.col("pe"), F.col("pn"), F.col("pc"), F.col("kg_score"), beta))
    pick = lambda k, raw: F.when(F.col("kg_hit"), F.col(f"_f.{k}")).otherwise(F.col(raw))
    c = c.withColumns({"fe": pick("e", "pe"), "fn": pick("n", "pn"), "fc": pick("c", "pc")}).drop("_f")
    return c.withColumn("fused_label", scores.argmax_enc(F.col("fe"), F.col("fn"), F.col("fc")))


def documents(fused: DataFrame, scored: DataFrame, config: dict, edges: int, key: str = "query_id") -> DataFrame:
    """(key, claims, config, diagnostics, top_edges): one document a query of fused claims.

    ``config`` holds the parameters of the run; diagnostics the numbers of claims, of claims with a hit and of score
    rows; top_edges the ``edges`` best distinct score rows (eid_head, eid_tail, p_final), ties by ids.
    """
    best = scored.where(F.col(key).isNotNull()).select(key, "eid_head", "eid_tail", F.when(~F.isnan("p_final"), F.col("p_final")).alias("p_final")).where("p_final IS NOT NULL").distinct()
    best = top_k(best, [key], edges, F.desc("p_final"), F.asc("eid_head"), F.asc("eid_tail"))
    top = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "eid_head", "eid_tail", "p_final"))), lambda x: x.dropFields("rank")).alias("top_edges"))
    claim = F.struct("claim_idx", "pe", "pn", "pc", "fe", "fn", "fc", "fused_label", "kg_score", "kg_hit")
    d = fused.groupBy(key).agg(F.array_sort(F.collect_list(claim)).alias("claims"), F.count("*").alias("n_claims"), F.count_if("kg_hit").alias("n_with_graph"))  # claims of one query
    rows = scored.groupBy(key).agg(F.count("*").alias("n_scores"))
    own = F.struct(*(F.lit(v).alias(k) for k, v in config.items()))
    j = d.join(top, key, "left").join(rows, key, "left")
    return j.select(key, "claims", own.alias("config"), F.struct("n_claims", "n_with_graph", F.coalesce("n_scores", F.lit(0)).alias("n_scores")).alias("diagnostics"), "top_edges")


def _share(c: Column) -> Column:
    return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))


def _range(c: Column, name: str) -> list[Column]:
    return [F.coalesce(F.min(c), F.lit(0.0)).alias(f"{name}_min"), F.coalesce(F.max(c), F.lit(0.0)).alias(f"{name}_max")]


#: Bins a unit of value, of which only those that hold a wanted rank are looked at value by value.
BINS = 4096


def quantiles(rows: DataFrame, group: list[str], values: dict[str, Column], probs: dict[str, float]) -> DataFrame:
    """(group, <value>_<prob>): exact quantiles, interpolated between neighbouring ranks; null where a value is always null.

    Rows are counted by bin first; the values of the few bins that hold a wanted rank are then counted and ranked, so
    neither an aggregation buffer nor a window ever holds all distinct values of a group.
    """
    each = rows.select(*group, F.inline(F.array(*(F.struct(F.lit(k).alias("name"), c.cast("double").alias("v")) for k, c in values.items())))).where("v IS NOT NULL").withColumn("bin", F.floor(F.col("v") * BINS))
    key = [*group, "name"]
    sizes = each.groupBy(*key, "bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*key)
    sizes = sizes.withColumn("n", F.sum("c").over(w)).withColumn("before", F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    # the two ranks, from 0, between which each probability lies
    at = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = F.array(*(F.struct(F.lit(k).alias("prob"), F.lit(side).alias("side"), (F.floor(at(p)) if side == "lo" else F.ceil(at(p))).cast("long").alias("rank"), (at(p) - F.floor(at(p))).alias("part")) for k, p in probs.items() for side in ("lo", "hi")))
    want = sizes.withColumn("x", F.explode(ranks)).where((F.col("x.rank") >= F.col("before")) & (F.col("x.rank") < F.col("before") + F.col("c")))
    want = want.select(*key, "bin", "before", "x.*")
    held = each.join(want.select(*key, "bin").distinct(), [*key, "bin"], "left_semi").groupBy(*key, "bin", "v").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*key, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = held.withColumn("upto", upto).join(want, [*key, "bin"]).where((F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("k")))
    one = hit.groupBy(*key, "prob").agg(F.max(F.when(F.col("side") == "lo", F.col("v"))).alias("lo"), F.max(F.when(F.col("side") == "hi", F.col("v"))).alias("hi"), F.max("part").alias("part"))
    one = one.withColumn("q", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    return one.groupBy(*group).agg(*(F.max(F.when((F.col("name") == v) & (F.col("prob") == p), F.col("q"))).alias(f"{v}_{p}") for v in values for p in probs))


def summary(fused: DataFrame, file: str, query: str = "query_id") -> DataFrame:
    """One row a file: coverage, label shares, changes, quantiles of scores and of the change of entailment.

    ``fused`` has pe, pn, pc, fe, fn, fc (null where not fused), kg_score, kg_hit.  Faithfulness is the share of
    entailed claims and hallucination its complement; ``contradicted_*`` are the stricter shares.
    """
    nli = scores.argmax_enc(F.col("pe"), F.col("pn"), F.col("pc"))
    has = F.col("fe").isNotNull()
    fl = F.when(has, scores.argmax_enc(F.col("fe"), F.col("fn"), F.col("fc")))
    d = fused.withColumns({"_n": nli, "_f": fl, "_has": has, "_cov": F.col("kg_score") > 0, "_d": F.when(has, F.col("fe") - F.col("pe")), "_ks": F.when(F.col("kg_score") > 0, F.col("kg_score"))})
    if_ = lambda cond, x: F.when(cond, x)
    q = quantiles(d, [file], {"kg_score": F.col("kg_score"), "kg_score_cov": F.col("_ks"), "delta_pe": F.col("_d")}, {"p50": 0.5, "p90": 0.9})
    s = d.groupBy(file).agg(
        F.countDistinct(query).alias("n_queries"), F.count("*").alias("n_claims"), F.count_if("_has").alias("fused_available_claims"), _share(F.col("_has")).alias("fused_available_rate"),
        _share(F.col("_cov")).alias("kg_cov_claim_rate"), _share(F.col("kg_hit")).alias("kg_hit_claim_rate"), _share(F.col("_cov") & F.col("_has")).alias("kg_cov_fused_rate"), _share(F.col("kg_hit") & F.col("_has")).alias("kg_hit_fused_rate"),
        *_range(F.col("kg_score"), "kg_score"), *_range(F.col("_ks"), "kg_score_cov"), F.coalesce(F.avg("_ks"), F.lit(0.0)).alias("kg_score_cov_mean"),
        _share(F.col("_n") == "entailed").alias("nli_ent_rate"), _share(F.col("_n") == "neutral").alias("nli_neu_rate"), _share(F.col("_n") == "contradicted").alias("nli_con_rate"),
        _share(if_(has, F.col("_f") == "entailed")).alias("fused_ent_rate"), _share(if_(has, F.col("_f") == "neutral")).alias("fused_neu_rate"), _share(if_(has, F.col("_f") == "contradicted")).alias("fused_con_rate"),
        _share(F.col("_n") == "entailed").alias("faith_nli"), (1 - _share(F.col("_n") == "entailed")).alias("hall_nli"),
        _share(if_(has, F.col("_f") == "entailed")).alias("faith_fused"), F.when(F.count_if("_has") > 0, 1 - _share(if_(has, F.col("_f") == "entailed"))).otherwise(0.0).alias("hall_fused"),
        _share(if_(has, F.col("_f") != F.col("_n"))).alias("pred_change_rate"),
        _share(if_(F.col("_cov"), F.col("_n") == "entailed")).alias("kg_cov_ent_rate_nli"), _share(if_(F.col("_cov") & has, F.col("_f") == "entailed")).alias("kg_cov_ent_rate_fused"),
        _share(if_(F.col("kg_hit"), F.col("_n") == "entailed")).alias("kg_hit_ent_rate_nli"), _share(if_(F.col("kg_hit") & has, F.col("_f") == "entailed")).alias("kg_hit_ent_rate_fused"),
        *_range(F.col("_d"), "delta_pe"), F.coalesce(F.avg("_d"), F.lit(0.0)).alias("delta_pe_mean"),
    )
    return s.join(q, file, "left").fillna(0.0, [f"{v}_{p}" for v in ("kg_score", "kg_score_cov", "delta_pe") for p in ("p50", "p90")])


def with_parameters(summaries: DataFrame, documents_: DataFrame, file: str) -> DataFrame:
    """Summaries with path, fusion_type, alpha and beta of their files; ``documents_`` has (file, v, claims ARRAY<VARIANT>)."""
    p = documents_.select(file, accessors.fusion_parameters(F.col("v"), F.col("claims")).alias("_p"))
    j = summaries.join(p, file, "left").withColumn("path", F.col(file))
    return j.withColumns({"fusion_type": F.coalesce("_p.fusion_type", F.lit("unknown")), "alpha": F.col("_p.alpha"), "beta": F.col("_p.beta")}).drop("_p")
