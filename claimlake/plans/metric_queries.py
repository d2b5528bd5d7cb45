"""Queries on fused probabilities and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlake.functions import scores, text
from claimlake.operators import fusion, kgscore, metrics
from claimlake.operators.ranking import top_k
from claimlake.plans.kg_queries import _P
from claimlake.plans.registry import query
from claimlake.plans.text_queries import STRIP

_EPS = 1e-6


def _claims(t):
    s = t("student_claims_flat").where("query_id IS NOT NULL AND claim_idx IS NOT NULL")
    return s.groupBy("query_id", "claim_idx").agg(F.max_by("nli", F.coalesce("nli.p_entailed", F.lit(-1.0))).alias("nli"), F.max("gold_label").alias("gold_label"), F.max("teacher_label").alias("teacher_label"), F.max("claim_text").alias("claim_text"))


def _fused(t):
    return fusion.fuse(fusion.attach(fusion.probabilities(_claims(t)), kgscore.index(t("kge_scores"))))


_BASE = f"""c AS (SELECT query_id, claim_idx, coalesce(max(nli.p_entailed), 0.0) AS pe, arg_max(nli.p_neutral, coalesce(nli.p_entailed, -1)) AS pn0, arg_max(nli.p_contradicted, coalesce(nli.p_entailed, -1)) AS pc0, max(gold_label) AS gold_label, max(teacher_label) AS teacher_label, max(claim_text) AS claim_text
  FROM student_claims_flat WHERE query_id IS NOT NULL AND claim_idx IS NOT NULL GROUP BY query_id, claim_idx),
kx AS (SELECT query_id, count(*) FILTER (WHERE node_hit) AS n_node_hit, count(*) FILTER (WHERE pair_hit) AS n_pair_hit, greatest(0, max({_P})) AS score, bool_or(coalesce(node_hit, FALSE) OR coalesce(pair_hit, FALSE)) AS hit, bool_or(coalesce(pair_hit, FALSE)) AS pair FROM kge_scores WHERE query_id IS NOT NULL GROUP BY query_id),
j AS (SELECT c.*, coalesce(pn0, 0.0) AS pn, coalesce(pc0, 0.0) AS pc, coalesce(hit, FALSE) AS kg_hit, CASE WHEN hit THEN greatest(0, least(1, kx.score)) ELSE 0.0 END AS kg_score FROM c LEFT JOIN kx USING (query_id)),
r AS (SELECT *, CASE WHEN pe + pn + pc > 1e-12 THEN pe / (pe + pn + pc) ELSE 1.0 / 3 END AS e1, CASE WHEN pe + pn + pc > 1e-12 THEN pn / (pe + pn + pc) ELSE 1.0 / 3 END AS n1, CASE WHEN pe + pn + pc > 1e-12 THEN pc / (pe + pn + pc) ELSE 1.0 / 3 END AS c1 FROM j),
m AS (SELECT *, 1 / (1 + exp(-(0.8 * ln(greatest({_EPS}, least(1 - {_EPS}, e1)) / (1 - greatest({_EPS}, least(1 - {_EPS}, e1)))) + (1 - 0.8) * ln(greatest({_EPS}, least(1 - {_EPS}, kg_score)) / (1 - greatest({_EPS}, least(1 - {_EPS}, kg_score))))))) AS me, CASE WHEN n1 + c1 > 1e-12 THEN n1 / (n1 + c1) ELSE 0.5 END AS sh FROM r),
f AS (SELECT *, CASE WHEN kg_hit THEN me ELSE pe END AS fe, CASE WHEN kg_hit THEN (1 - me) * sh ELSE pn END AS fn, CASE WHEN kg_hit THEN (1 - me) * (1 - sh) ELSE pc END AS fc FROM m),
ff AS (SELECT *, CASE WHEN fe >= fn AND fe >= fc THEN 'entailed' WHEN fn >= fe AND fn >= fc THEN 'neutral' ELSE 'contradicted' END AS fused_label, CASE WHEN pe >= pn AND pe >= pc THEN 'entailed' WHEN pn >= pe AND pn >= pc THEN 'neutral' ELSE 'contradicted' END AS nli_label FROM f)"""


@query("WITH " + _BASE + " SELECT query_id, claim_idx, round(fe, 6) AS fe, round(fn, 6) AS fn, round(fc, 6) AS fc, fused_label FROM ff")
def logit_fusion(t):
    return _fused(t).select("query_id", "claim_idx", F.round("fe", 6).alias("fe"), F.round("fn", 6).alias("fn"), F.round("fc", 6).alias("fc"), "fused_label")


@query("WITH " + _BASE + """, a AS (SELECT query_id, claim_idx, least(1.0, pe + 0.8 * greatest(0, kg_score - 0.3)) AS e, greatest(0, pc) AS c, greatest(0, pn) AS n FROM j)
SELECT query_id, claim_idx, round(e / (e + c + n + 1e-9), 6) AS e, round(c / (e + c + n + 1e-9), 6) AS c, round(n / (e + c + n + 1e-9), 6) AS n, CASE WHEN e >= c AND e >= n THEN 'entailed' WHEN c >= e AND c >= n THEN 'contradicted' ELSE 'neutral' END AS label FROM a""")
def additive_fusion(t):
    f = _fused(t).withColumn("x", scores.fuse_additive(F.col("pe"), F.col("pc"), F.col("pn"), F.col("kg_score")))
    return f.select("query_id", "claim_idx", F.round("x.e", 6).alias("e"), F.round("x.c", 6).alias("c"), F.round("x.n", 6).alias("n"), scores.argmax_ecn(F.col("x.e"), F.col("x.c"), F.col("x.n")).alias("label"))


_TITLE = "CASE {0} WHEN 'entailed' THEN 'Entailment' WHEN 'contradicted' THEN 'Contradiction' ELSE 'Neutral' END"


def _title(c):
    return F.when(c == "entailed", "Entailment").when(c == "contradicted", "Contradiction").otherwise("Neutral")


@query("WITH " + _BASE + ", l AS (SELECT *, " + _TITLE.format("nli_label") + " AS l FROM ff) SELECT query_id, claim_idx, CASE WHEN l = 'Entailment' AND kg_score < 0.25 THEN 'Neutral' WHEN l = 'Neutral' AND kg_score > 0.55 THEN 'Entailment' ELSE l END AS label FROM l")
def label_threshold_fusion(t):
    f = _fused(t).withColumn("l", _title(scores.argmax_enc(F.col("pe"), F.col("pn"), F.col("pc"))))
    return f.select("query_id", "claim_idx", scores.fuse_label(F.col("l"), F.col("kg_score")).alias("label"))


def _q(col, name, where=""):
    return f"round(coalesce(min({col}){where}, 0), 6) AS {name}_min, round(coalesce(quantile_cont({col}, 0.5){where}, 0), 6) AS {name}_p50, round(coalesce(quantile_cont({col}, 0.9){where}, 0), 6) AS {name}_p90, round(coalesce(max({col}){where}, 0), 6) AS {name}_max"


def _s(cond, name, where="TRUE"):
    return f"round(coalesce(avg(CAST({cond} AS DOUBLE)) FILTER (WHERE {where}), 0), 6) AS {name}"


_SUMMARY = ("WITH " + _BASE + ", z AS (SELECT *, substr(query_id, 1, 2) AS file, kg_hit AS has, CASE WHEN kg_hit THEN fused_label END AS fl, CASE WHEN kg_hit THEN fe - pe END AS d FROM ff) SELECT file, count(DISTINCT query_id) AS n_queries, count(*) AS n_claims, count(*) FILTER (WHERE has) AS fused_available_claims, "
    + ", ".join([_s("has", "fused_available_rate"), _s("kg_score > 0", "kg_cov_claim_rate"), _s("kg_hit", "kg_hit_claim_rate"), _s("kg_score > 0 AND has", "kg_cov_fused_rate"), _s("kg_hit AND has", "kg_hit_fused_rate"), _q("kg_score", "kg_score"), _q("kg_score", "kg_score_cov", " FILTER (WHERE kg_score > 0)"),
        "round(coalesce(avg(kg_score) FILTER (WHERE kg_score > 0), 0), 6) AS kg_score_cov_mean", _s("nli_label = 'entailed'", "nli_ent_rate"), _s("nli_label = 'neutral'", "nli_neu_rate"), _s("nli_label = 'contradicted'", "nli_con_rate"), _s("fl = 'entailed'", "fused_ent_rate", "has"), _s("fl = 'neutral'", "fused_neu_rate", "has"), _s("fl = 'contradicted'", "fused_con_rate", "has"),
        _s("nli_label = 'entailed'", "faith_nli"), "round(1 - coalesce(avg(CAST(nli_label = 'entailed' AS DOUBLE)), 0), 6) AS hall_nli", _s("fl = 'entailed'", "faith_fused", "has"), "round(CASE WHEN count(*) FILTER (WHERE has) > 0 THEN 1 - avg(CAST(fl = 'entailed' AS DOUBLE)) FILTER (WHERE has) ELSE 0 END, 6) AS hall_fused",
        _s("fl <> nli_label", "pred_change_rate", "has"), _s("nli_label = 'entailed'", "kg_cov_ent_rate_nli", "kg_score > 0"), _s("fl = 'entailed'", "kg_cov_ent_rate_fused", "kg_score > 0 AND has"), _s("nli_label = 'entailed'", "kg_hit_ent_rate_nli", "kg_hit"), _s("fl = 'entailed'", "kg_hit_ent_rate_fused", "kg_hit AND has"), _q("d", "delta_pe"), "round(coalesce(avg(d), 0), 6) AS delta_pe_mean"])
    + " FROM z GROUP BY file")


@query(_SUMMARY)
def fusion_summary(t):
    """One row a dataset (the stand-in for a file); claims without a hit count as not fused."""
    f = _fused(t).withColumn("file", F.substring("query_id", 1, 2))
    f = f.withColumns({k: F.when(F.col("kg_hit"), F.col(k)) for k in ("fe", "fn", "fc")})
    s = fusion.summary(f, "file")
    return s.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in s.dtypes))


@query("WITH " + _BASE + ", q AS (SELECT query_id, 100 * avg(CAST(fused_label = 'entailed' AS DOUBLE)) AS f, 100 * avg(CAST(fused_label = 'contradicted' AS DOUBLE)) AS h FROM ff GROUP BY query_id) SELECT substr(query_id, 1, 2) AS dataset, count(*) AS n_q, round(avg(f), 6) AS faithfulness, round(avg(h), 6) AS hallucination FROM q GROUP BY 1")
def qlevel_faithfulness(t):
    q = metrics.question_level(_fused(t), "query_id", "fused_label")
    return q.groupBy(F.substring("query_id", 1, 2).alias("dataset")).agg(F.count("*").alias("n_q"), F.round(F.avg("faithfulness"), 6).alias("faithfulness"), F.round(F.avg("hallucination"), 6).alias("hallucination"))


@query("WITH " + _BASE + """, q AS (SELECT query_id, 100 * avg(CAST(nli_label = 'entailed' AS DOUBLE)) AS f, 100 * avg(CAST(nli_label = 'contradicted' AS DOUBLE)) AS h FROM ff GROUP BY query_id)
SELECT substr(query_id, 1, 2) AS dataset, count(*) AS n_q, round(100 * avg(CAST(coalesce(n_node_hit > 0, FALSE) AS DOUBLE)), 6) AS cov_node, round(100 * avg(CAST(coalesce(n_pair_hit > 0, FALSE) AS DOUBLE)), 6) AS cov_pair, round(avg(h), 6) AS hall_all, round(avg(h) FILTER (WHERE n_pair_hit > 0), 6) AS hall_kg, round(avg(f), 6) AS faith_all, round(avg(f) FILTER (WHERE n_pair_hit > 0), 6) AS faith_kg FROM q LEFT JOIN kx USING (query_id) GROUP BY 1""")
def kg_effect(t):
    f = _fused(t).withColumn("nli_label", scores.argmax_enc(F.col("pe"), F.col("pn"), F.col("pc")))
    q = metrics.question_level(f, "query_id", "nli_label").withColumn("dataset", F.substring("query_id", 1, 2))
    g = metrics.graph_effect(q, kgscore.index(t("kge_scores")), "query_id", ["dataset"])
    return g.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in g.dtypes))


@query("SELECT o_orderstatus AS dataset, o_orderpriority AS generator, o_orderkey AS run, o_totalprice AS n_q FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def best_run(t):
    """The largest run of each setting; ties go to the first."""
    o = t("orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("generator"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("n_q"))
    return top_k(o, ["dataset", "generator"], 1, F.desc("n_q"), F.asc("run")).drop("rank")


def _canon_sql(c):
    return f"CASE lower({STRIP(c)}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**text.STRICT_LABELS, "entailment": "entailed", "contradiction": "contradicted"}.items()) + " END"


_LAB = f"WITH p AS (SELECT query_id, claim_idx, {_canon_sql('gold_label')} AS y, {_canon_sql('teacher_label')} AS p FROM student_claims_flat WHERE gold_label IS NOT NULL)"


def _labelled(t):
    c = lambda x: F.coalesce(text.label_strict(x), text.label_exact(text.strip(x)))
    return t("student_claims_flat").where("gold_label IS NOT NULL").select("query_id", "claim_idx", c("gold_label").alias("y"), c("teacher_label").alias("p"))


_D = "(VALUES ('entailed'), ('contradicted'), ('neutral')) d(label)"
_TPS = f"s AS (SELECT label, count(*) FILTER (WHERE y IS NOT DISTINCT FROM label AND p IS NOT DISTINCT FROM label) AS tp, count(*) FILTER (WHERE y IS DISTINCT FROM label AND p IS NOT DISTINCT FROM label) AS fp, count(*) FILTER (WHERE y IS NOT DISTINCT FROM label AND p IS DISTINCT FROM label) AS fn FROM {_D}, p GROUP BY label), x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM s), y AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM x)"


@query(_LAB + ", " + _TPS + " SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, tp + fn AS support FROM y")
def prf_per_label(t):
    m = metrics.per_label(_labelled(t), "y", "p")
    return m.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in m.dtypes))


@query(_LAB + ", " + _TPS + " SELECT (SELECT count(*) FROM p) AS n, (SELECT round(coalesce(avg(CAST(y = p AS DOUBLE)), 0), 6) FROM p) AS accuracy, round(sum(f1) / 3, 6) AS macro_f1 FROM y")
def prf_macro(t):
    return metrics.macro(_labelled(t), "y", "p").select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(_LAB + f" SELECT label AS y_true, count(*) FILTER (WHERE p = 'entailed' AND y = label) AS entailed, count(*) FILTER (WHERE p = 'contradicted' AND y = label) AS contradicted, count(*) FILTER (WHERE p = 'neutral' AND y = label) AS neutral FROM {_D}, p GROUP BY label")
def confusion(t):
    return metrics.confusion(_labelled(t), "y", "p")


@query(_LAB + """, k AS (SELECT y, p FROM p WHERE y IN ('entailed', 'contradicted', 'neutral') AND p IN ('entailed', 'contradicted', 'neutral')), n AS (SELECT count(*) AS n FROM p),
e AS (SELECT sum(a.c * b.c) AS s FROM (SELECT y, count(*) AS c FROM k GROUP BY y) a JOIN (SELECT p, count(*) AS c FROM k GROUP BY p) b ON a.y = b.p)
SELECT round(((SELECT count(*) FROM k WHERE y = p) / n - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, e""")
def cohen_kappa(t):
    return metrics.kappa(_labelled(t), "y", "p").select(F.round("kappa", 6).alias("kappa"))


@query(_LAB + " SELECT y AS label, count(*) AS n, round(avg(CAST(y IS NOT DISTINCT FROM p AS DOUBLE)), 6) AS accuracy FROM p GROUP BY y")
def per_class_accuracy(t):
    return _labelled(t).groupBy(F.col("y").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("y").eqNullSafe(F.col("p")).cast("double")), 6).alias("accuracy"))


@query(f"WITH s AS (SELECT query_id, max_by(teacher_label, claim_idx) FILTER (WHERE teacher_label IS NOT NULL) AS dummy FROM student_claims_flat GROUP BY query_id), p AS (SELECT query_id, claim_idx, max({_canon_sql('gold_label')}) AS a, max({_canon_sql('teacher_label')}) AS b FROM student_claims_flat WHERE query_id IS NOT NULL AND claim_idx IS NOT NULL GROUP BY 1, 2) SELECT a AS student, b AS teacher, count(*) AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2")
def teacher_agreement(t):
    """Positions that both label sets have, by (query, claim position)."""
    c = lambda x: F.coalesce(text.label_strict(x), text.label_exact(text.strip(x)))
    s = t("student_claims_flat").where("query_id IS NOT NULL AND claim_idx IS NOT NULL")
    a = s.groupBy("query_id", "claim_idx").agg(F.max(c("gold_label")).alias("student")).where("student IS NOT NULL")
    b = s.groupBy("query_id", "claim_idx").agg(F.max(c("teacher_label")).alias("teacher")).where("teacher IS NOT NULL")
    return a.join(b, ["query_id", "claim_idx"]).groupBy("student", "teacher").agg(F.count("*").alias("n"))


@query("WITH " + _BASE + " SELECT substr(query_id, 1, 2) AS dataset, count(*) AS n_claims, count(gold_label) AS n_gold, count(*) FILTER (WHERE claim_text IS NULL OR claim_text = '') AS n_no_text, round(avg(CAST(gold_label = nli_label AS DOUBLE)) FILTER (WHERE gold_label IS NOT NULL), 6) AS accuracy FROM ff GROUP BY 1")
def legacy_metrics(t):
    """Accuracy on claims with gold only; null where a dataset has none."""
    f = _fused(t).withColumn("nli_label", scores.argmax_enc(F.col("pe"), F.col("pn"), F.col("pc")))
    return f.groupBy(F.substring("query_id", 1, 2).alias("dataset")).agg(
        F.count("*").alias("n_claims"), F.count("gold_label").alias("n_gold"), F.count_if(F.coalesce("claim_text", F.lit("")) == "").alias("n_no_text"),
        F.round(F.avg(F.when(F.col("gold_label").isNotNull(), (F.col("gold_label") == F.col("nli_label")).cast("double"))), 6).alias("accuracy"),
    )


@query("SELECT event_type, round(avg(CASE WHEN value > 90 THEN value END), 6) AS mean_or_null, round(coalesce(avg(CASE WHEN value > 1e9 THEN value END), 0), 6) AS mean_or_zero, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def safe_means(t):
    v = F.col("value")
    return t("events").groupBy("event_type").agg(F.round(F.avg(F.when(v > 90, v)), 6).alias("mean_or_null"), F.round(F.coalesce(F.avg(F.when(v > 1e9, v)), F.lit(0.0)), 6).alias("mean_or_zero"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


@query("WITH " + _BASE + " SELECT round(avg(CAST(fused_label = 'entailed' AS DOUBLE)), 6) AS faithfulness, round(avg(CAST(fused_label = 'contradicted' AS DOUBLE)), 6) AS hallucination, round(sum(CASE WHEN fused_label = 'entailed' THEN kg_score ELSE 0 END) / sum(kg_score), 6) AS weighted_adherence FROM ff")
def faith_hall(t):
    f = _fused(t)
    return f.agg(F.round(F.avg((F.col("fused_label") == "entailed").cast("double")), 6).alias("faithfulness"), F.round(F.avg((F.col("fused_label") == "contradicted").cast("double")), 6).alias("hallucination"), F.round(metrics.weighted_share(F.col("fused_label") == "entailed", F.col("kg_score")), 6).alias("weighted_adherence"))


@query(_LAB + " SELECT query_id, claim_idx, CAST(CASE WHEN y = p THEN 1.0 ELSE 0.0 END AS DOUBLE) AS reward FROM p")
def reward(t):
    return _labelled(t).select("query_id", "claim_idx", metrics.reward(F.col("p"), F.col("y")).alias("reward"))


@query(_LAB + ", r AS (SELECT query_id, claim_idx, CASE WHEN y = p THEN 1.0 ELSE -1.0 END AS v FROM p WHERE query_id IS NOT NULL) SELECT query_id, claim_idx, round((v - avg(v) OVER w) / (coalesce(stddev_samp(v) OVER w, 0) + 1e-6), 5) AS advantage FROM r WINDOW w AS (PARTITION BY query_id)")
def advantage_norm(t):
    r = _labelled(t).where("query_id IS NOT NULL").select("query_id", "claim_idx", (2 * metrics.reward(F.col("p"), F.col("y")) - 1).alias("v"))
    return metrics.advantages(r, "query_id", "v").select("query_id", "claim_idx", F.round("advantage", 5).alias("advantage"))


@query("SELECT user_id, round(sum(value * CASE WHEN k = n - 1 THEN power(0.9, k) ELSE 0.1 * power(0.9, k) END), 6) AS ema FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id")
def ema_values(t):
    return metrics.last_ema(t("events"), "user_id", "value", [F.col("ts"), F.col("event_id")], 0.1, F.to_date("ts")).select("user_id", F.round("ema", 6).alias("ema"))


@query("WITH " + _BASE + """, q AS (SELECT query_id, count(*) AS n_claims, count(*) FILTER (WHERE kg_hit) AS covered, query_id IN (SELECT query_id FROM kge_scores) AS scored FROM ff GROUP BY query_id)
SELECT n_claims % 3 AS slot, count(*) AS n_total, count(*) FILTER (WHERE scored) AS n_done, count(*) FILTER (WHERE NOT scored) AS n_skipped, count(*) FILTER (WHERE scored AND covered = 0) AS n_zero_coverage FROM q GROUP BY 1""")
def batch_summary(t):
    """What a batch of fusions did, a run a query: done, skipped for want of scores, and done without any claim covered."""
    known = t("kge_scores").select("query_id").where("query_id IS NOT NULL").distinct().withColumn("scored", F.lit(True))
    runs = _fused(t).groupBy("query_id").agg(F.count("*").alias("n_claims"), F.count_if("kg_hit").alias("covered")).join(known, "query_id", "left")
    return metrics.batch(runs.withColumn("slot", F.col("n_claims") % 3), ["slot"], F.coalesce("scored", F.lit(False)), F.col("covered"))


@query("SELECT gold_label AS label, count(*) AS n FROM student_claims_flat GROUP BY gold_label")
def label_histogram(t):
    return t("student_claims_flat").groupBy(F.col("gold_label").alias("label")).agg(F.count("*").alias("n"))
