"""Claim-level, question-level and run-level metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.operators.ranking import top_k

LABELS = ("entailed", "contradicted", "neutral")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_label(pairs: DataFrame, true: str, pred: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, support): one pass over the pairs; 0 where a denominator is."""
    t, p = F.col(true), F.col(pred)
    one = pairs.agg(
        F.array(*(F.struct(F.lit(x).alias("label"), F.count_if(t.eqNullSafe(x) & p.eqNullSafe(x)).alias("tp"), F.count_if(~t.eqNullSafe(x) & p.eqNullSafe(x)).alias("fp"), F.count_if(t.eqNullSafe(x) & ~p.eqNullSafe(x)).alias("fn")) for x in labels)).alias("x")
    )
    d = one.select(F.inline("x"))
    pr, rc = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return d.select("label", "tp", "fp", "fn", pr.alias("precision"), rc.alias("recall"), _ratio(2 * pr * rc, pr + rc).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def macro(pairs: DataFrame, true: str, pred: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row (n, accuracy, macro_f1); the macro mean divides by the number of labels, present or not."""
    f = per_label(pairs, true, pred, labels).agg((F.sum("f1") / len(labels)).alias("macro_f1"))
    n = pairs.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col(true) == F.col(pred)).cast("double")), F.lit(0.0)).alias("accuracy"))
    return n.crossJoin(F.broadcast(f))  # one row each


def confusion(pairs: DataFrame, true: str, pred: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(true label, one count column a predicted label)."""
    c = pairs.where(F.col(true).isin(*labels)).groupBy(F.col(true).alias("y_true")).pivot(pred, list(labels)).count()
    every = pairs.sparkSession.createDataFrame([(x,) for x in labels], "y_true string")
    return every.join(c, "y_true", "left").fillna(0)


def kappa(pairs: DataFrame, true: str, pred: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row (kappa): labels outside the domain stay in the number of pairs; full chance agreement gives 1."""
    t, p = F.col(true), F.col(pred)
    known = t.isin(*labels) & p.isin(*labels)
    a = pairs.agg(F.count("*").alias("n"), F.count_if(known & (t == p)).alias("agree"), *(F.count_if(known & (t == x)).alias(f"r{i}") for i, x in enumerate(labels)), *(F.count_if(known & (p == x)).alias(f"c{i}") for i, x in enumerate(labels)))
    n = F.col("n").cast("double")
    po = F.col("agree") / n
    pe = sum((F.col(f"r{i}") * F.col(f"c{i}") for i in range(len(labels))), F.lit(0)) / (n * n)
    return a.select(F.when(F.col("n") == 0, 0.0).when(pe == 1.0, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def overlap(pred: DataFrame, gold: DataFrame, key: str, claims: str) -> DataFrame:
    """(key, tp, fp, fn, precision, recall, f1) of claim sets of the keys on both sides."""
    j = pred.select(key, F.array_distinct(claims).alias("p")).join(gold.select(key, F.array_distinct(claims).alias("g")), key)
    tp = F.size(F.array_intersect("p", "g"))
    d = j.select(key, tp.alias("tp"), (F.size("p") - tp).alias("fp"), (F.size("g") - tp).alias("fn"))
    pr, rc = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return d.select(key, "tp", "fp", "fn", pr.alias("precision"), rc.alias("recall"), _ratio(2 * pr * rc, pr + rc).alias("f1"))


def question_level(claims: DataFrame, question: str, label: str) -> DataFrame:
    """(question, faithfulness, hallucination) in percent: shares of entailed and of contradicted claims."""
    return claims.groupBy(question).agg((100 * F.avg((F.col(label) == "entailed").cast("double"))).alias("faithfulness"), (100 * F.avg((F.col(label) == "contradicted").cast("double"))).alias("hallucination"))


def graph_effect(questions: DataFrame, index: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Per group: coverage by node and pair hits in percent, mean metrics of all questions and of those with a pair hit."""
    flags = index.select(key, (F.col("n_node_hit") > 0).alias("_n"), (F.col("n_pair_hit") > 0).alias("_p"))
    j = questions.join(flags, key, "left").withColumns({"_n": F.coalesce("_n", F.lit(False)), "_p": F.coalesce("_p", F.lit(False))})
    pct = lambda c: 100 * F.avg(c.cast("double"))
    return j.groupBy(*group).agg(
        F.count("*").alias("n_q"), pct(F.col("_n")).alias("cov_node"), pct(F.col("_p")).alias("cov_pair"), F.avg("hallucination").alias("hall_all"), F.avg(F.when(F.col("_p"), F.col("hallucination"))).alias("hall_kg"),
        F.avg("faithfulness").alias("faith_all"), F.avg(F.when(F.col("_p"), F.col("faithfulness"))).alias("faith_kg"),
    )


def reward(pred: Column, gold: Column) -> Column:
    """1 for an exact match, else 0."""
    return F.when(pred.eqNullSafe(gold) & gold.isNotNull(), 1.0).otherwise(0.0)


def advantages(samples: DataFrame, group: str, value: str) -> DataFrame:
    """``samples`` with ``advantage``: (value - mean) / (sample deviation + 1e-6) of its group."""
    s = samples.groupBy(group).agg(F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s"))
    return samples.join(s, group).withColumn("advantage", (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-6)).drop("_m", "_s")


def last_ema(rows: DataFrame, key: str, value: str, order: list[Column], alpha: float, span: Column | None = None) -> DataFrame:
    """(key, ema): exponential moving average after the last value, which begins with the first value.

    The closed form weighs each value by its distance from the end.  ``span``, which must grow with ``order`` (a day, a
    range of positions), cuts the rows of a key into pieces: each piece is weighed on its own, so no task ranks all rows
    of a frequent key, and the pieces are then discounted by the rows after them.
    """
    piece = span if span is not None else F.lit(0)
    r = rows.select(key, piece.alias("_p"), F.col(value).cast("double").alias("_v"), *(c.alias(f"_o{i}") for i, c in enumerate(order)))
    by = [F.col(f"_o{i}").desc() for i in range(len(order))]
    r = r.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_p").orderBy(*by)) - 1)
    parts = r.groupBy(key, "_p").agg(F.sum(F.col("_v") * alpha * F.pow(F.lit(1 - alpha), F.col("_k"))).alias("_s"), F.count("*").alias("_n"), F.max_by("_v", "_k").alias("_first"))
    w = Window.partitionBy(key).orderBy(F.desc("_p"))
    parts = parts.withColumn("_after", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the first value of all has the weight of everything before it too: 1 - alpha more times what alpha leaves
    head = F.max_by(F.struct("_first", (F.col("_after") + F.col("_n") - 1).alias("k")), F.struct(F.col("_after"), F.col("_n")))
    d = parts.groupBy(key).agg(F.sum(F.col("_s") * F.pow(F.lit(1 - alpha), F.col("_after"))).alias("_s"), head.alias("_h"))
    return d.select(key, (F.col("_s") + F.col("_h._first") * (1 - alpha) * F.pow(F.lit(1 - alpha), F.col("_h.k"))).alias("ema"))


def context_metrics(claims_supported: DataFrame, chunk_gains: DataFrame, key: str, k: int) -> DataFrame:
    """Documented retrieval and generation metrics of each query.

    ``claims_supported``: (key, supported, refuted, gold_covered, used, n_claims, n_gold); ``chunk_gains``: (key, rank, gain)
    with gain the number of gold claims that a chunk entails.  Gives precision of the first k chunks, claim
    recall, faithfulness, hallucination, utilisation, and nDCG@k.
    """
    c = chunk_gains.where(F.col("rank") <= k)
    ideal = chunk_gains.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("gain")))).where(F.col("_i") <= k)
    dcg = c.groupBy(key).agg(F.avg((F.col("gain") > 0).cast("double")).alias("context_precision"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("_dcg"), F.count_if(F.col("gain") > 0).alias("_rel"))
    best = ideal.groupBy(key).agg(F.sum(F.col("gain") / F.log2(F.col("_i") + 1)).alias("_idcg"))
    total = chunk_gains.groupBy(key).agg(F.count_if(F.col("gain") > 0).alias("_all"))
    j = claims_supported.join(dcg, key).join(best, key).join(total, key)
    return j.select(
        key, "context_precision", _ratio(F.col("gold_covered"), F.col("n_gold")).alias("claim_recall"), _ratio(F.col("supported"), F.col("n_claims")).alias("faithfulness"), _ratio(F.col("refuted"), F.col("n_claims")).alias("hallucination"),
        _ratio(F.col("used"), F.col("n_claims")).alias("context_utilisation"), _ratio(F.col("_rel"), F.col("_all")).alias("recall_at_k"), _ratio(F.col("_dcg"), F.col("_idcg")).alias("ndcg"),
    )


def weighted_share(flag: Column, weight: Column) -> Column:
    """Share of weight with the flag, such as adherence weighted by source authority; 0 without weight."""
    return F.coalesce(F.try_divide(F.sum(F.when(flag, weight).otherwise(0.0)), F.sum(weight)), F.lit(0.0))


def batch(runs: DataFrame, group: list[str], done: Column, covered: Column) -> DataFrame:
    """(group, n_total, n_done, n_skipped, n_zero_coverage) of a run table; done runs that cover nothing are suspicious."""
    return runs.groupBy(*group).agg(F.count("*").alias("n_total"), F.count_if(done).alias("n_done"), F.count_if(~done).alias("n_skipped"), F.count_if(done & (covered == 0)).alias("n_zero_coverage"))


def first_overlap(queries: DataFrame, scored: DataFrame, group: str, key: str, order: str, n: int = 200) -> DataFrame:
    """(group, n_looked, overlap): share of the first ``n`` queries of each group that are among the scored ones.  The cap is the
    feature: a quick look whether two files belong together."""
    first = top_k(queries.select(group, key, order) if order != key else queries.select(group, key), [group], n, F.asc(order))
    known = scored.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_s", F.lit(1.0))
    return first.join(known, key, "left").groupBy(group).agg(F.count("*").alias("n_looked"), F.avg(F.coalesce("_s", F.lit(0.0))).alias("overlap"))
