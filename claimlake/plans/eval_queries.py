"""Queries on drifting result files, parameters, targets and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlake.functions import scores, text
from claimlake.operators import accessors, claims, fusion, kgscore, linking, metrics
from claimlake.plans.distill_queries import _RAG, _TOK, _labels, _rag, _sent
from claimlake.plans.metric_queries import _BASE, _TITLE, _claims, _fused, _title
from claimlake.plans.registry import query
from claimlake.plans.text_queries import NORM, STRIP


def _record(**fields):
    """JSON text of a record; null members are left out."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _nli(e="p_entailed", n="p_neutral", c="p_contradicted"):
    return F.struct(F.col("nli.p_entailed").alias(e), F.col("nli.p_neutral").alias(n), F.col("nli.p_contradicted").alias(c))


def _drifted(t):
    """Claims as records of five shapes, by claim number."""
    c = _claims(t)
    i = F.col("claim_idx") % 5
    probs, nli, fused = _nli("entailed", "neutral", "contradicted"), _nli(), _nli()
    wrong = F.struct(F.lit(0.5).alias("p_entailed"))
    rec = (
        F.when(i == 0, _record(nli=nli, kg_fused=wrong, fused=fused, kg_score=F.lit(0.25)))
        .when(i == 1, _record(probs=probs, nli=wrong, fused=fused, kg_hit=F.lit(False), kg_score=F.lit(0.9)))
        .when(i == 2, _record(probs=F.lit("x"), nli=nli, kg_fused=fused, kg_hit=F.lit(1)))
        .when(i == 3, _record(nli=nli, kg_score=F.lit("0.5")))
        .otherwise(_record(kg_score=F.lit("none")))
    )
    return c.withColumn("v", F.parse_json(rec))


_C = """c AS (SELECT query_id, claim_idx, max(nli.p_entailed) AS e, arg_max(nli.p_neutral, coalesce(nli.p_entailed, -1)) AS n, arg_max(nli.p_contradicted, coalesce(nli.p_entailed, -1)) AS c, max(gold_label) AS gold_label, max(teacher_label) AS teacher_label, max(claim_text) AS claim_text
  FROM student_claims_flat WHERE query_id IS NOT NULL AND claim_idx IS NOT NULL GROUP BY query_id, claim_idx)"""


@query(f"""WITH {_C}, p AS (SELECT *, claim_idx % 5 AS i, e IS NOT NULL AND n IS NOT NULL AND c IS NOT NULL AS whole FROM c)
SELECT query_id, claim_idx, CASE WHEN i < 4 THEN coalesce(e, 0) ELSE 0 END AS pe, CASE WHEN i < 4 THEN coalesce(n, 0) ELSE 0 END AS pn, CASE WHEN i < 4 THEN coalesce(c, 0) ELSE 0 END AS pc, CASE WHEN i IN (1, 2) AND whole THEN e END AS fe, CASE WHEN i IN (1, 2) AND whole THEN c END AS fc,
i IN (0, 2, 3) AS kg_hit, CASE i WHEN 0 THEN 0.25 WHEN 1 THEN 0.9 WHEN 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS kg_score FROM p""")
def claim_accessors(t):
    """Probabilities, fused probabilities, hits and scores of records in five shapes."""
    v = F.col("v")
    d = _drifted(t).select("query_id", "claim_idx", accessors.claim_probabilities(v).alias("p"), accessors.fused_probabilities(v).alias("f"), accessors.graph_hit(v).alias("kg_hit"), accessors.graph_score(v).alias("kg_score"))
    return d.select("query_id", "claim_idx", F.col("p.e").alias("pe"), F.col("p.n").alias("pn"), F.col("p.c").alias("pc"), F.col("f.e").alias("fe"), F.col("f.c").alias("fc"), "kg_hit", "kg_score")


@query(f"WITH {_C} SELECT query_id, claim_idx, e, n, c, CASE WHEN claim_idx % 3 = 2 AND gold_label IS NULL THEN teacher_label WHEN claim_idx % 3 = 2 THEN gold_label ELSE teacher_label END AS gold FROM c WHERE e IS NOT NULL AND n IS NOT NULL AND c IS NOT NULL AND claim_idx % 4 <> 3")
def flat_accessors(t):
    """Flat records under both spellings, nested or not, with either label; a quarter lacks a probability and is dropped."""
    i, m = F.col("claim_idx") % 3, F.col("claim_idx") % 4
    key = {"query_id": F.col("query_id"), "claim_idx": F.col("claim_idx")}
    short = {"p_entail": F.col("nli.p_entailed"), "p_neutral": F.col("nli.p_neutral"), "p_contra": F.col("nli.p_contradicted")}
    rec = (
        F.when(m == 3, _record(**key, nli=F.struct(F.col("nli.p_entailed").alias("p_entailed"), F.col("nli.p_neutral").alias("p_neutral"))))
        .when(i == 0, _record(**key, nli=_nli(), teacher_label=F.col("teacher_label"))).when(i == 1, _record(**key, **short, teacher_label=F.col("teacher_label")))
        .otherwise(_record(**key, nli=_nli("p_entail", "p_neutral", "p_contra"), gold_label=F.col("gold_label"), teacher_label=F.col("teacher_label")))
    )
    d = _claims(t).select(accessors.flat_probabilities(F.parse_json(rec)).alias("x")).where("x IS NOT NULL")
    return d.select("x.query_id", "x.claim_idx", "x.e", "x.n", "x.c", "x.gold")


@query("""WITH q AS (SELECT query_id, count(*) AS k FROM (SELECT DISTINCT query_id, claim_idx FROM student_claims_flat WHERE query_id IS NOT NULL AND claim_idx IS NOT NULL) GROUP BY query_id)
SELECT query_id, CASE k % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.7 WHEN 2 THEN NULL END::DOUBLE AS alpha, CASE WHEN k % 4 = 1 THEN 0.6 WHEN k % 4 = 2 AND k > 1 THEN 0.9 END::DOUBLE AS beta, CASE k % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'beta' ELSE 'unknown' END AS fusion_type FROM q""")
def fusion_parameters(t):
    """Parameters from the configuration, from the second claim, or nowhere, by the number of claims of a file."""
    c = _claims(t).select("query_id", "claim_idx", F.row_number().over(_by("query_id", "claim_idx")).alias("i"))
    one = F.when(F.col("i") == 2, '{"kg_fused": {"beta": 0.9}}').otherwise('{"kg_fused": 1}')
    d = c.groupBy("query_id").agg(F.count("*").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", one.alias("j")))), lambda x: x["j"]), ",").alias("j"))  # claims of one query
    k = F.col("k") % 4
    config = F.when(k == 0, '{"kg_fusion_config": {"alpha": 0.8}}').when(k == 1, '{"kg_fusion_config": {"alpha": "0.7", "beta": 0.6}}').otherwise('{"kg_fusion_config": "x"}')
    listed = F.when(k == 2, F.concat(F.lit("["), "j", F.lit("]"))).otherwise("[]")
    p = accessors.fusion_parameters(F.parse_json(config), F.parse_json(listed).cast("array<variant>"))
    return d.select("query_id", p.alias("p")).select("query_id", "p.*")


def _by(*c):
    from pyspark.sql import Window

    return Window.partitionBy(c[0]).orderBy(*c[1:])


@query("SELECT query_id, CAST(claim_idx AS INTEGER) AS claim_idx, query_id AS s, 'rel' AS r, CASE WHEN claim_idx % 4 = 2 THEN '5' ELSE claim_text END AS o FROM (SELECT query_id, claim_idx, max(claim_text) AS claim_text FROM student_claims_flat WHERE query_id IS NOT NULL AND claim_idx IS NOT NULL GROUP BY 1, 2) WHERE claim_idx % 4 >= 2")
def leading_triples(t):
    """Claims of two, three and four members and plain ones; those of at least three give their first three."""
    i = F.col("claim_idx") % 4
    q = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    rec = F.when(i == 0, F.concat(F.lit("["), q("claim_text"), F.lit("]"))).when(i == 1, F.concat(F.lit("[["), q("query_id"), F.lit(',"rel"]]'))).when(i == 2, F.concat(F.lit("[["), q("query_id"), F.lit(',"rel",5]]'))).otherwise(F.concat(F.lit("[["), q("query_id"), F.lit(',"rel",'), q("claim_text"), F.lit(',"more"]]')))
    return _claims(t).select("query_id", F.col("claim_idx").cast("int").alias("claim_idx"), F.explode(accessors.leading_triples(F.parse_json(rec))).alias("x")).select("query_id", "claim_idx", "x.*")


@query(f"WITH {_C} SELECT query_id, claim_idx, coalesce(claim_text, '') AS claim_text FROM c")
def claim_text_lookup(t):
    """Every other claim has lost its text and gets it from the lookup."""
    c = _claims(t).select("query_id", "claim_idx", "claim_text")
    lost = c.withColumn("claim_text", F.when(F.col("claim_idx") % 2 == 0, F.col("claim_text")).otherwise(""))
    return accessors.with_claim_texts(lost, c)


@query(f"""WITH {_RAG}, s AS (SELECT query_id, {_sent('rag_response')} AS c, list_transform(coalesce(retrieved_context, []), lambda d: coalesce(d.text, '')) AS e FROM r),
k AS (SELECT query_id, e, c[i] AS claim, i - 1 AS ci FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM s)), p AS (SELECT query_id, ci, j - 1 AS di, claim, {NORM('e[j]')} AS ev FROM (SELECT *, unnest(range(1, len(e) + 1)) AS j FROM k)),
l AS (SELECT *, CASE (ci + di) % 4 WHEN 0 THEN 'entailed' END AS label FROM p WHERE ev <> '')
SELECT query_id, CAST(ci AS INTEGER) AS claim_no, CAST(di AS INTEGER) AS doc_no, label, md5('You are an NLI checker. Read the claim and the evidence, then answer with ONE token: <entailed> or <contradicted> or <neutral>.' || chr(10) || chr(10) || 'Claim: ' || claim || chr(10) || chr(10) || 'Evidence: ' || ev || chr(10) || chr(10) || 'Answer:') AS prompt_md5 FROM l WHERE label IS NOT NULL""")
def nli_pairs(t):
    """All aligned pairs, repeated claims and short evidence too; only labels in the canonical spelling are known."""
    return accessors.nli_pairs(_labels(t), "query_id", "claims", "evidence", "labels").select("query_id", "claim_no", "doc_no", "label", F.md5("prompt").alias("prompt_md5"))


_SIDES = """u AS (SELECT DISTINCT id FROM qa_items WHERE id IS NOT NULL), s AS (SELECT query_id AS id, coalesce(min(claim_text), '') AS txt, count(DISTINCT claim_idx) % 3 AS k, count(gold_label) > 0 AS gold FROM student_claims_flat WHERE query_id IS NOT NULL GROUP BY query_id)"""


@query(f"""WITH {_SIDES}, x AS (SELECT u.id, s.id AS sid, txt, k, gold, CASE WHEN gold AND k < 2 THEN 1 WHEN k < 2 AND s.id IS NOT NULL THEN 2 WHEN s.id IS NOT NULL AND {NORM('txt')} <> '' THEN 3 END AS kind FROM u LEFT JOIN s ON s.id = u.id)
SELECT id, gold AND k < 2 AS has_gold, md5(CASE kind WHEN 1 THEN '[["' || id || '", "gold", "x"]]' WHEN 2 THEN '[["' || id || '", "said", "y"]]' WHEN 3 THEN '[' || CAST(to_json({NORM('txt')}) AS VARCHAR) || ']' END) AS target_md5 FROM x""")
def unified_targets(t):
    """Gold triples before the teacher's, triples before claims; the teacher's triples come under either name."""
    u = t("qa_items").where("id IS NOT NULL").select("id").distinct()
    s = t("student_claims_flat").where("query_id IS NOT NULL").groupBy(F.col("query_id").alias("id")).agg(F.coalesce(F.min("claim_text"), F.lit("")).alias("txt"), (F.countDistinct("claim_idx") % 3).alias("k"), (F.count("gold_label") > 0).alias("gold"))
    tri = lambda rel, o: F.array(F.array(F.col("id"), F.lit(rel), F.lit(o)))
    teacher = F.when(F.col("k") == 0, _record(pred_triples=tri("said", "y"), pred_claims=F.array("txt"))).when(F.col("k") == 1, _record(pred_claims=tri("said", "y"))).otherwise(_record(pred_claims=F.array("txt")))
    gold = F.when(F.col("k") < 2, _record(pred_triples=tri("gold", "x"))).otherwise(_record(pred_claims=F.array("txt")))
    out = accessors.unified_targets(u, s.select("id", F.parse_json(teacher).alias("v")), s.where("gold").select("id", F.parse_json(gold).alias("v")))
    known = s.select("id", (F.col("gold") & (F.col("k") < 2)).alias("g"))
    return out.join(known, "id", "left").select("id", F.col("g").alias("has_gold"), F.md5("target").alias("target_md5"))


_STRICT = lambda c: f"CASE lower({STRIP(c)}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.STRICT_LABELS.items()) + " END"
_F1 = lambda x, t="g", p="p": f"coalesce(2.0 * count(*) FILTER (WHERE {t} = '{x}' AND {p} = '{x}') / nullif(count(*) FILTER (WHERE {t} IS NOT NULL AND {p} = '{x}') + count(*) FILTER (WHERE {t} = '{x}'), 0), 0)"
_SOME = lambda x, t="g": f"CASE WHEN count({t}) > 0 THEN round({x}, 6) END"


@query("WITH " + _BASE + f""", d AS (SELECT claim_idx % 7 AS slot, CASE WHEN claim_idx % 7 < 6 THEN {_STRICT('gold_label')} END AS g, nli_label AS p FROM ff)
SELECT slot, count(g) AS n, {_SOME("count(*) FILTER (WHERE g = p) / count(g)")} AS accuracy, {_SOME("(" + " + ".join(_F1(x) for x in ("entailed", "contradicted", "neutral")) + ") / 3")} AS macro_f1, {", ".join(_SOME(_F1(x)) + f" AS f1_{x}" for x in ("entailed", "contradicted", "neutral"))} FROM d GROUP BY slot""")
def grouped_f1(t):
    """Accuracy, macro-F1 and F1 by label of each group; the last group has no gold labels and gets nulls."""
    f = _fused(t).withColumn("slot", F.col("claim_idx") % 7).withColumn("g", F.when(F.col("slot") < 6, text.label_strict("gold_label"))).withColumn("p", scores.argmax_enc(F.col("pe"), F.col("pn"), F.col("pc")))
    m = accessors.grouped_f1(f, ["slot"], "g", "p")
    return m.select("slot", "n", *(F.round(c, 6).alias(c) for c in m.columns[2:]))


_T3 = ("Entailment", "Neutral", "Contradiction")


@query("WITH " + _BASE + ", l AS (SELECT *, " + _TITLE.format("nli_label") + " AS l, CASE WHEN " + _STRICT("teacher_label") + " IS NOT NULL THEN " + _TITLE.format("(" + _STRICT("teacher_label") + ")") + " END AS g FROM ff), "
"d AS (SELECT g, l AS p, CASE WHEN l = 'Entailment' AND kg_score < 0.25 THEN 'Neutral' WHEN l = 'Neutral' AND kg_score > 0.55 THEN 'Entailment' ELSE l END AS q FROM l) "
f"SELECT {_SOME('(' + ' + '.join(_F1(x) for x in _T3) + ') / 3')} AS macro_f1_before, {_SOME('(' + ' + '.join(_F1(x, p='q') for x in _T3) + ') / 3')} AS macro_f1_after, count(g) AS n FROM d")
def posthoc_effect(t):
    """Macro-F1 over the three title-case labels against the teacher, before and after labels are corrected by scores."""
    g = text.label_strict("teacher_label")
    f = _fused(t).withColumn("l", _title(scores.argmax_enc(F.col("pe"), F.col("pn"), F.col("pc")))).withColumn("g", F.when(g.isNotNull(), _title(g)))
    f = f.withColumn("q", scores.fuse_label(F.col("l"), F.col("kg_score")))
    a = accessors.grouped_f1(f, [], "g", "l", _T3).select("n", F.round("macro_f1", 6).alias("macro_f1_before"))
    b = accessors.grouped_f1(f, [], "g", "q", _T3).select(F.round("macro_f1", 6).alias("macro_f1_after"))
    return a.crossJoin(F.broadcast(b))  # one row each


@query("WITH " + _BASE + f""", d AS (SELECT claim_idx % 3 AS slot, kg_hit AS critical, {_STRICT('gold_label')} AS g, fused_label AS p, kg_score AS w FROM ff)
SELECT slot, count(*) FILTER (WHERE critical) AS n_critical, round(avg(CASE WHEN critical THEN coalesce(CAST(g <> p AS DOUBLE), 0) END), 6) AS error_rate, round(coalesce(sum(CASE WHEN g = p THEN w ELSE 0 END) / nullif(sum(w), 0), 0), 6) AS adherence FROM d GROUP BY slot""")
def safety_metrics(t):
    """Error rate among the critical claims (here those with a hit), and agreement with the reference weighted by authority (here the score)."""
    f = _fused(t).withColumn("slot", F.col("claim_idx") % 3).withColumn("g", text.label_strict("gold_label"))
    e = accessors.error_rate(f, ["slot"], F.col("kg_hit"), F.col("g") != F.col("fused_label"))
    a = f.groupBy("slot").agg(metrics.weighted_share(F.col("g").eqNullSafe(F.col("fused_label")), F.col("kg_score")).alias("adherence"))
    return e.join(a, "slot").select("slot", "n_critical", F.round("error_rate", 6).alias("error_rate"), F.round("adherence", 6).alias("adherence"))


_NAMES = "n AS (SELECT name, raw_id FROM name_map UNION ALL SELECT name || ' x', '0' || CAST(length(name) AS VARCHAR) FROM name_map WHERE name IS NOT NULL)"


@query(f"""WITH {_NAMES}, s AS (SELECT {NORM('lower(name)')} AS surface, trim(raw_id) AS raw_id FROM n WHERE name IS NOT NULL), r AS (SELECT surface, s.raw_id, coalesce(e.idx, CASE WHEN regexp_full_match(s.raw_id, '[0-9]+') THEN CAST(s.raw_id AS BIGINT) END) AS eid FROM s LEFT JOIN entities e ON e.raw_id = s.raw_id WHERE surface <> '' AND surface <> 'nan')
SELECT 'raw' AS rules, surface, arg_max(eid, (raw_id, eid)) AS eid FROM r WHERE eid IS NOT NULL GROUP BY surface UNION ALL SELECT 'digits', surface, arg_max(eid, (raw_id, eid)) FROM r WHERE eid IS NOT NULL GROUP BY surface""")
def name_map_orders(t):
    """Name maps under two more rule orders: the raw id as a name before digits, and digits only before the second column."""
    e = t("entities").where("raw_id IS NOT NULL").select(F.col("raw_id").alias("name"), F.col("idx").alias("eid"))
    m = t("name_map").select("name", "raw_id")
    n = m.unionByName(m.where("name IS NOT NULL").select(F.concat("name", F.lit(" x")).alias("name"), F.concat(F.lit("0"), F.length("name").cast("string")).alias("raw_id")))
    ids = ("raw_id", *linking.ID_COLUMNS)
    raw = linking.resolve_names(n, e, F.col("raw_id"), ("raw", "id"), "name", ids)
    digits = linking.resolve_names(n, e, F.col("raw_id"), ("id", "entity", "second"), "name", ids)
    return raw.select(F.lit("raw").alias("rules"), "surface", "eid").unionByName(digits.select(F.lit("digits").alias("rules"), "surface", "eid"))


@query(f"SELECT CASE WHEN contains(raw_id, '::') THEN split_part(raw_id, '::', 1) ELSE 'Unknown' END AS kind, raw_id, count(DISTINCT name) AS n_aliases, min(name) AS first_alias FROM (SELECT {STRIP('name')} AS name, {STRIP('raw_id')} AS raw_id FROM name_map) WHERE name <> '' AND raw_id <> '' GROUP BY raw_id")
def alias_groups(t):
    a = accessors.alias_groups(t("name_map"))
    return a.select("kind", "raw_id", F.size("aliases").cast("long").alias("n_aliases"), F.array_min("aliases").alias("first_alias"))


@query("WITH " + _BASE + """, e AS (SELECT query_id, eid_head, eid_tail, p_final, row_number() OVER (PARTITION BY query_id ORDER BY p_final DESC, eid_head, eid_tail) AS i FROM (SELECT DISTINCT query_id, eid_head, eid_tail, CASE WHEN isnan(p_final) THEN NULL ELSE p_final END AS p_final FROM kge_scores WHERE query_id IS NOT NULL) WHERE p_final IS NOT NULL)
SELECT query_id, count(*) AS n_claims, count(*) FILTER (WHERE kg_hit) AS n_with_graph, 0.8 AS beta, 'max' AS agg, (SELECT count(*) FROM e WHERE e.query_id = ff.query_id AND i <= 2) AS n_edges, (SELECT max(eid_head) FROM e WHERE e.query_id = ff.query_id AND i = 1) AS best_head FROM ff GROUP BY query_id""")
def fused_documents(t):
    """One document a query: fused claims with the configuration, diagnostics and the two best graph edges."""
    d = fusion.documents(_fused(t), t("kge_scores"), {"beta": 0.8, "agg": "max"}, 2)
    return d.select("query_id", F.col("diagnostics.n_claims").alias("n_claims"), F.col("diagnostics.n_with_graph").alias("n_with_graph"), F.col("config.beta").alias("beta"), F.col("config.agg").alias("agg"), F.coalesce(F.size("top_edges"), F.lit(0)).cast("long").alias("n_edges"), F.try_element_at("top_edges", F.lit(1))["eid_head"].alias("best_head"))


@query(f"""WITH {_RAG}, c AS (SELECT query_id, unnest({_sent('rag_response')}) AS g FROM r), ch AS (SELECT query_id, unnest(list_transform(coalesce(retrieved_context, []), lambda d: coalesce(d.text, ''))) AS ev FROM r),
z AS (SELECT c.query_id, g, {_TOK.format('g')} AS a, {_TOK.format('ev')} AS b FROM c JOIN ch USING (query_id)), j AS (SELECT query_id, g, max(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END) AS best FROM z GROUP BY 1, 2)
SELECT query_id, count(*) AS n_claims, round(count(*) FILTER (WHERE best >= 0.12) / count(*), 6) AS context_utilisation, round(count(*) FILTER (WHERE best >= 0.2) / count(*), 6) AS faithfulness, round(count(*) FILTER (WHERE best < 0.05) / count(*), 6) AS hallucination FROM j GROUP BY query_id""")
def context_use(t):
    """Shares of response claims with a chunk that uses (token Jaccard 0.12), supports (0.2) or not even touches (0.05) them."""
    tok = lambda c: F.array_distinct(text.kg_tokens(F.coalesce(c, F.lit(""))))
    g = _rag(t).select("query_id", F.explode(text.sentences(F.coalesce("rag_response", F.lit("")))).alias("g"), "retrieved_context")
    e = g.select("query_id", "g", F.posexplode("retrieved_context").alias("p", "d")).withColumn("rank", F.col("p") + 1).withColumn("j", text.jaccard(tok("g"), tok("d.text")))
    best = e.groupBy("query_id", "g").agg(F.max("j").alias("b"))
    c = best.groupBy("query_id").agg(F.count("*").alias("n_claims"), F.count_if(F.col("b") >= 0.2).alias("supported"), F.count_if(F.col("b") < 0.05).alias("refuted"), F.count_if(F.col("b") >= 0.12).alias("used"), F.lit(0).alias("gold_covered"), F.lit(0).alias("n_gold"))
    gains = e.groupBy("query_id", "rank").agg(F.count_if(F.col("j") >= 0.12).alias("gain"))
    m = metrics.context_metrics(c, gains, "query_id", 3).join(c.select("query_id", "n_claims"), "query_id")
    return m.select("query_id", "n_claims", *(F.round(x, 6).alias(x) for x in ("context_utilisation", "faithfulness", "hallucination")))


@query("WITH " + _BASE + " SELECT substr(query_id, 1, 2) AS file, substr(query_id, 1, 2) AS path, count(*) AS n_claims, CASE substr(query_id, 1, 2) WHEN 'pu' THEN 'alpha' WHEN 'me' THEN 'beta' ELSE 'unknown' END AS fusion_type, CASE substr(query_id, 1, 2) WHEN 'pu' THEN 0.8 WHEN 'me' THEN 0.7 END::DOUBLE AS alpha, CASE WHEN substr(query_id, 1, 2) = 'me' THEN 0.6 END::DOUBLE AS beta FROM ff GROUP BY 1")
def fusion_run_columns(t):
    """The columns of a summary that come from the configuration of its file."""
    f = _fused(t).withColumn("file", F.substring("query_id", 1, 2))
    config = F.when(F.col("file") == "pu", '{"kg_fusion_config": {"alpha": 0.8}}').when(F.col("file") == "me", '{"kg_fusion_config": {"alpha": 0.7, "beta": "0.6"}}').otherwise("{}")
    docs = f.select("file").distinct().select("file", F.parse_json(config).alias("v"), F.array().cast("array<variant>").alias("claims"))
    s = fusion.with_parameters(fusion.summary(f, "file"), docs, "file")
    return s.select("file", "path", "n_claims", "fusion_type", "alpha", "beta")


@query("WITH " + _BASE + """, fq AS (SELECT query_id, row_number() OVER (PARTITION BY substr(query_id, 1, 2) ORDER BY query_id) AS i FROM (SELECT DISTINCT query_id FROM ff))
SELECT substr(query_id, 1, 2) AS file, count(*) AS n_looked, round(avg(CAST(query_id IN (SELECT query_id FROM kge_scores) AS DOUBLE)), 6) AS overlap FROM fq WHERE i <= 20 GROUP BY 1""")
def first_overlap(t):
    """Share of the first queries of each file that have scores; here the first 20, as a file's diagnostics have the first 200."""
    q = _claims(t).select("query_id").distinct().withColumn("file", F.substring("query_id", 1, 2))
    return metrics.first_overlap(q, t("kge_scores"), "file", "query_id", "query_id", 20).withColumn("overlap", F.round("overlap", 6))
