"""Queries on entities, links, graph scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlake.functions import scores, text
from claimlake.operators import kgscore, linking
from claimlake.operators.ranking import top_k
from claimlake.plans.registry import query
from claimlake.plans.text_queries import _ALIAS, NORM


def _surfaces(t):
    """Curated names first, generated aliases where they have none."""
    e = t("entities").select(F.col("raw_id").alias("name"), F.col("idx").alias("eid")).where("raw_id IS NOT NULL")
    n = linking.resolve_names(t("name_map"), e, F.col("raw_id"), ("id", "entity", "second"), "name")
    return linking.merge(n, linking.alias_table(t("entities"), "raw_id", "idx"))


_SURF = (
    _ALIAS
    + f""", al AS (SELECT surface, min(idx) AS eid FROM s GROUP BY surface),
nm AS (SELECT surface, arg_max(idx, n.raw_id) AS eid FROM (SELECT {NORM('lower(name)')} AS surface, trim(raw_id) AS raw_id FROM name_map WHERE name IS NOT NULL) n JOIN entities e ON e.raw_id = n.raw_id WHERE surface <> '' AND surface <> 'nan' GROUP BY surface),
surf AS (SELECT surface, eid FROM nm UNION ALL SELECT surface, eid FROM al WHERE surface NOT IN (SELECT surface FROM nm))"""
)


@query(_SURF + " SELECT surface, eid FROM surf")
def surface_dictionary(t):
    return _surfaces(t)


_GRAMS = ", ".join(f"CASE WHEN len(toks) >= {k} THEN list_transform(range(1, len(toks) - {k} + 2), lambda i: array_to_string(toks[i:i + {k - 1}], ' ')) ELSE [] END" for k in range(1, 6))


@query(_SURF + f""", q AS (SELECT query_id, regexp_extract_all(lower(coalesce(query, '')), '{text.KG_TOKEN}') AS toks FROM (SELECT DISTINCT query_id, query FROM rag_rows WHERE query_id IS NOT NULL)),
g AS (SELECT query_id, unnest(flatten([{_GRAMS}])) AS surface FROM q)
SELECT DISTINCT query_id, eid FROM g JOIN surf USING (surface)""")
def ngram_entity_link(t):
    return linking.mentions(t("rag_rows").where("query_id IS NOT NULL").select("query_id", "query").distinct(), "query_id", "query", _surfaces(t))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(raw_id, '::') THEN string_split(raw_id, '::')[1] ELSE 'Unknown' END AS kind FROM entities) GROUP BY kind")
def entity_types(t):
    return t("entities").groupBy(text.entity_type("raw_id").alias("kind")).agg(F.count("*").alias("n"))


_LINES = ["name\tid", "alpha\t5", "7\tbeta", "gamma\tdelta", "9\t9", "alpha\t6", "", "short"]


@query("SELECT * FROM (VALUES ('row', 'alpha', 6), ('row', 'beta', 7), ('row', 'gamma', 2), ('row', '9', 3), ('drop', 'alpha', 6), ('drop', 'beta', 7)) v(variant, name, eid)")
def entity_lines(t):
    """Literal lines: both column orders, a header, a repeated name, ambiguous, blank and short lines."""
    lines = t("region").sparkSession.createDataFrame(list(enumerate(_LINES)), "line_no int, line string")
    parts = [linking.entity_lines(lines, "line", "line_no", ambiguous=a).withColumn("variant", F.lit(a)) for a in ("row", "drop")]
    return parts[0].unionByName(parts[1])


@query(f"SELECT surface, arg_max(idx, n.raw_id) AS eid FROM (SELECT {NORM('lower(name)')} AS surface, trim(raw_id) AS raw_id FROM name_map WHERE name IS NOT NULL) n JOIN entities e ON e.raw_id = n.raw_id WHERE surface <> '' AND surface <> 'nan' GROUP BY surface")
def name_map_resolve(t):
    e = t("entities").where("raw_id IS NOT NULL").select(F.col("raw_id").alias("name"), F.col("idx").alias("eid"))
    return linking.resolve_names(t("name_map"), e, F.col("raw_id"), ("id", "entity", "second"), "name")


_P = "coalesce(CASE WHEN NOT isnan(p_final) THEN p_final END, 0.0)"
_KG = "WITH k AS (SELECT query_id, " + _P + " AS s, coalesce(node_hit, FALSE) AS n, coalesce(pair_hit, FALSE) AS p FROM kge_scores WHERE query_id IS NOT NULL)"
_INDEX = """SELECT query_id, count(*) AS n_rows, count(*) FILTER (WHERE n) AS n_node_hit, count(*) FILTER (WHERE p) AS n_pair_hit, round(greatest(0, max(s)), 6) AS max_score, round({score}, 6) AS score,
bool_or(n OR p) AS hit, CASE WHEN bool_or(p) THEN 'pair' WHEN bool_or(n) THEN 'node' ELSE 'none' END AS hit_type FROM {src} GROUP BY query_id"""


def _rounded(df):
    return df.withColumn("max_score", F.round("max_score", 6)).withColumn("score", F.round("score", 6))


@query(_KG + _INDEX.format(score="greatest(0, max(s))", src="k"))
def kge_index_max(t):
    return _rounded(kgscore.index(t("kge_scores")))


@query(_KG + _INDEX.format(score="coalesce(max(s) FILTER (WHERE n OR p), greatest(0, max(s)))", src="k"))
def kge_index_hit_only(t):
    return _rounded(kgscore.index(t("kge_scores"), hit_only=True))


@query(_KG + _INDEX.format(score="avg(s) FILTER (WHERE r <= 10)", src="(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS r FROM k)"))
def kge_index_mean_topk(t):
    return _rounded(kgscore.index(t("kge_scores"), agg="mean_topk"))


@query(f"SELECT count(*) AS n_lines, count(*) FILTER (WHERE query_id IS NULL) AS n_missing_qid, count(*) FILTER (WHERE p_final IS NULL) AS n_missing_score, round(min({_P}) FILTER (WHERE query_id IS NOT NULL), 6) AS score_min, round(max({_P}) FILTER (WHERE query_id IS NOT NULL), 6) AS score_max, count(*) FILTER (WHERE query_id IS NOT NULL AND {_P} > 0) AS score_gt0, count(*) FILTER (WHERE coalesce(node_hit, FALSE) OR coalesce(pair_hit, FALSE)) AS n_hit_true FROM kge_scores")
def kge_file_stats(t):
    return kgscore.file_stats(t("kge_scores"), "p_final", "node_hit", "pair_hit").withColumn("score_min", F.round("score_min", 6)).withColumn("score_max", F.round("score_max", 6))


@query(f"SELECT query_id, rank, round(s, 6) AS p_final FROM (SELECT query_id, {_P} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {_P} DESC) AS rank FROM kge_scores WHERE query_id IS NOT NULL) WHERE rank <= 10")
def topk_edges(t):
    k = t("kge_scores").where("query_id IS NOT NULL").select("query_id", scores.safe_double(F.col("p_final")).alias("p_final"))
    return top_k(k, ["query_id"], 10, F.desc("p_final")).select("query_id", F.col("rank").cast("long").alias("rank"), F.round("p_final", 6).alias("p_final"))


_CAL = """WITH k AS (SELECT query_id, eid_head, eid_tail, coalesce(p_final, 0.0) AS s FROM kge_scores WHERE query_id IS NOT NULL AND p_final IS NOT NULL), b AS (SELECT min(s) AS lo, max(s) AS hi FROM k)
SELECT query_id, eid_head, eid_tail, round(CASE WHEN hi - lo <= 1e-12 THEN 0 ELSE greatest(0, least(1, (s - lo) / (hi - lo))) END, 6) AS by_range, round(1 / (1 + exp(-6 * (s - 0.5))), 6) AS by_sigmoid FROM k, b"""


@query(_CAL)
def score_calibration(t):
    k = t("kge_scores").where("query_id IS NOT NULL AND p_final IS NOT NULL").select("query_id", "eid_head", "eid_tail", F.col("p_final").alias("s"))
    m = kgscore.calibrated(k, "s", "minmax").withColumnRenamed("calibrated", "m")
    return m.select("query_id", "eid_head", "eid_tail", F.round("m", 6).alias("by_range"), F.round(scores.calibrate(F.col("s"), "sigmoid", F.lit(0.0), F.lit(1.0)), 6).alias("by_sigmoid"))


def _groups(t):
    e = t("embeddings").select("label", F.floor(F.col("vec_id") / 40).alias("g"), "vec_id")
    return e.groupBy("label", "g").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.concat_ws("-", "label", "g").alias("claim"), "ids")  # at most 40 ids


_PAIRS = """g AS (SELECT CAST(label AS VARCHAR) || '-' || CAST(CAST(floor(vec_id / 40) AS BIGINT) AS VARCHAR) AS claim, vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label, floor(vec_id / 40) ORDER BY vec_id) AS i FROM embeddings),
pp AS (SELECT x.claim, x.vec_id AS a, y.vec_id AS b, list_distance(x.e, y.e) AS dist, row_number() OVER (PARTITION BY x.claim ORDER BY x.i, y.i) AS n FROM g x JOIN g y ON x.claim = y.claim AND x.i < y.i)"""


def _pairs(t, most):
    return kgscore.pair_scores(_groups(t), "claim", "ids", t("embeddings"), "vec_id", "embedding", most)


@query("WITH " + _PAIRS + " SELECT claim, a, b, round(dist, 6) AS dist, round(1 / (1 + dist), 6) AS score FROM pp WHERE n <= 80")
def entity_pair_scores(t):
    return _pairs(t, 80).select("claim", "a", "b", F.round("dist", 6).alias("dist"), F.round("score", 6).alias("score"))


@query("WITH " + _PAIRS + ", s AS (SELECT claim, 1 / (1 + dist) AS score, row_number() OVER (PARTITION BY claim ORDER BY dist) AS r FROM pp) SELECT claim, round(avg(score) FILTER (WHERE r <= 10), 6) AS mean_top FROM s GROUP BY claim")
def claim_kg_mean10(t):
    return kgscore.claim_scores(_pairs(t, None), "claim", 10).select("claim", F.round("mean_top", 6).alias("mean_top"))


@query("WITH " + _PAIRS + " SELECT claim, round(max(1 / (1 + dist)), 6) AS best, TRUE AS pair_hit FROM pp WHERE n <= 60 GROUP BY claim")
def claim_kg_max60(t):
    return kgscore.claim_scores(_pairs(t, 60), "claim").select("claim", F.round("best", 6).alias("best"), "pair_hit")


_CENT = "m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label)"


@query("WITH " + _CENT + """, r AS (SELECT a.label, list_transform(range(1, 65), lambda i: b.v[i] - a.v[i]) AS v FROM c a JOIN c b ON b.label = (a.label + 1) % 10)
SELECT head, tail, label, round(dist, 6) AS dist, round(1 / (1 + exp(dist)), 6) AS prob FROM (SELECT h.vec_id AS head, t.vec_id AS tail, h.label, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(CAST(h.embedding[i] AS DOUBLE) + r.v[i] - CAST(t.embedding[i] AS DOUBLE), 2)))) AS dist FROM embeddings h JOIN embeddings t ON t.vec_id = h.vec_id + 1 JOIN r ON r.label = h.label)""")
def transe_scores(t):
    e = t("embeddings")
    c = kgscore.centroids(e, "label", "embedding")
    r = c.select("label", F.col("vec").alias("v0")).join(c.select(F.pmod(F.col("label") - 1, F.lit(10)).cast("int").alias("label"), F.col("vec").alias("v1")), "label")
    r = r.select("label", F.zip_with("v1", "v0", lambda x, y: x - y).alias("rel"))
    h = e.select(F.col("vec_id").alias("head"), "label", F.col("embedding").alias("hv"))
    tail = e.select((F.col("vec_id") - 1).alias("head"), F.col("vec_id").alias("tail"), F.col("embedding").alias("tv"))
    j = h.join(tail, "head").join(r, "label").withColumn("dist", scores.translation_distance(F.col("hv"), F.col("rel"), F.col("tv")))
    return j.select("head", "tail", "label", F.round("dist", 6).alias("dist"), F.round(scores.translation_prob(F.col("dist")), 6).alias("prob"))


_SOFT = """WITH a AS (SELECT label % 3 AS kind, CAST(floor(vec_id / 5) AS BIGINT) AS entity, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT vec_id AS claim, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT claim, kind, entity, greatest(0, max(list_inner_product(q.v, a.v))) AS sim FROM q, a GROUP BY claim, kind, entity),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim, kind ORDER BY round(sim, 9) DESC, entity) AS r FROM s) WHERE r <= 5),
x AS (SELECT h.claim, h.entity AS head, t.entity AS tail, least(h.sim, t.sim) * (0.5 + 0.5 * 0.6) AS text_sim, 1 / (1 + exp(abs(h.entity - t.entity) / 50.0)) AS kge FROM k h JOIN k t ON h.claim = t.claim AND h.kind = 0 AND t.kind = 1),
f AS (SELECT *, CASE WHEN (head + tail) % 3 = 0 THEN text_sim ELSE 0.5 * kge + 0.5 * text_sim END AS final FROM x)
SELECT claim, head, tail, round(text_sim, 6) AS text_sim, round(final, 6) AS p_final FROM (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY round(final, 9) DESC, head, tail) AS r FROM f) WHERE r = 1"""


@query(_SOFT)
def soft_kg_argmax(t):
    """Best (head, tail) of each claim: nearest entities by type, graph score absent for a third of the pairs."""
    e = t("embeddings")
    alias = e.select((F.col("label") % 3).alias("kind"), F.floor(F.col("vec_id") / 5).alias("entity"), "embedding")
    claims = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("claim"), F.col("embedding").alias("qv"))
    c = kgscore.entity_candidates(claims, "claim", "qv", alias, "kind", "entity", "embedding", 5)
    head = c.where("kind = 0").select("claim", F.col("entity").alias("head"), F.col("sim").alias("hs"))
    tail = c.where("kind = 1").select("claim", F.col("entity").alias("tail"), F.col("sim").alias("ts"))
    x = head.join(tail, "claim").withColumn("text_sim", scores.text_score(F.col("hs"), F.col("ts"), F.lit(0.6)))
    kge = F.when((F.col("head") + F.col("tail")) % 3 != 0, scores.translation_prob(F.abs(F.col("head") - F.col("tail")) / 50.0))
    x = x.withColumn("p_final", scores.soft_score(kge, F.col("text_sim"), 0.5))
    return kgscore.best_triple(x, "claim", "p_final", F.asc("head"), F.asc("tail")).select("claim", "head", "tail", F.round("text_sim", 6).alias("text_sim"), F.round("p_final", 6).alias("p_final"))


@query("SELECT eid, raw_id FROM (SELECT DISTINCT eid_head AS eid FROM kge_scores WHERE eid_head IS NOT NULL) JOIN entities ON eid = idx")
def linked_entities(t):
    """Scored ids within the bounds of the entity table."""
    k = t("kge_scores").select(F.col("eid_head").alias("eid")).where("eid IS NOT NULL").distinct()
    return k.join(t("entities").select(F.col("idx").alias("eid"), "raw_id"), "eid")
