"""Queries on claims, training rows, samples and context packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlake.functions import text
from claimlake.operators import claims, context, metrics, paths, ranking
from claimlake.plans.registry import query
from claimlake.plans.text_queries import NORM, STRIP


def _rag(t):
    """One row a query: the latest build."""
    r = t("rag_rows").where("query_id IS NOT NULL")
    return r.groupBy("query_id").agg(F.max(F.struct("built_at", "query", "gt_answer", "rag_response")).alias("x"), F.max_by("retrieved_context", F.struct("built_at", "query", "gt_answer", "rag_response")).alias("retrieved_context")).select("query_id", "x.query", "x.gt_answer", "x.rag_response", "retrieved_context")


_RAG = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY built_at DESC NULLS LAST, query DESC NULLS LAST, gt_answer DESC NULLS LAST, rag_response DESC NULLS LAST) AS rn FROM rag_rows WHERE query_id IS NOT NULL) WHERE rn = 1)"


def _sent(c):
    # cut after . ! ? before white space
    return f"list_filter(list_transform(string_split(regexp_replace(coalesce({c}, ''), '([.!?])[\\s\\x0b]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {NORM('x')}), lambda x: x <> '')"


def _form(c):
    return f"trim(translate({NORM(f'lower({c})')}, '.,', ''))"


@query(f"""WITH {_RAG}, s AS (SELECT query_id, list_distinct(list_transform({_sent('rag_response')}, lambda x: {_form('x')})) AS p, list_distinct(list_transform({_sent('gt_answer')}, lambda x: {_form('x')})) AS g FROM r),
c AS (SELECT query_id, len(list_intersect(p, g)) AS tp, len(p) - len(list_intersect(p, g)) AS fp, len(g) - len(list_intersect(p, g)) AS fn FROM s), d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS a, coalesce(tp / nullif(tp + fn, 0), 0) AS b FROM c)
SELECT query_id, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, round(a, 6) AS precision, round(b, 6) AS recall, round(coalesce(2 * a * b / nullif(a + b, 0), 0), 6) AS f1 FROM d""")
def claim_overlap(t):
    r = _rag(t)
    s = lambda c: r.select("query_id", F.transform(text.sentences(F.coalesce(c, F.lit(""))), text.claim_form).alias("claims"))
    o = metrics.overlap(s("rag_response"), s("gt_answer"), "query_id", "claims")
    return o.select("query_id", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH {_RAG}, s AS (SELECT query_id, {_sent("rag_response || ' ' || rag_response")} AS c FROM r WHERE rag_response IS NOT NULL), e AS (SELECT query_id, unnest(c) AS claim, unnest(range(len(c))) AS i FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(claim) ORDER BY i) AS n FROM e)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INTEGER) AS pos, claim FROM k WHERE n = 1""")
def claim_dedup(t):
    """Sentences of the doubled response: every claim comes twice and is kept once."""
    r = _rag(t).where("rag_response IS NOT NULL")
    c = claims.distinct_claims(text.sentences(F.concat("rag_response", F.lit(" "), "rag_response")))
    return r.select("query_id", F.posexplode(c).alias("pos", "claim"))


_TOK = f"list_distinct(regexp_extract_all(lower({{0}}), '{text.KG_TOKEN}'))"


@query(f"""WITH {_RAG}, c AS (SELECT query_id, unnest({_sent('rag_response')}) AS claim FROM r), d AS (SELECT query_id, i, coalesce(retrieved_context[i].text, '') AS ev FROM (SELECT query_id, retrieved_context, unnest(range(1, len(retrieved_context) + 1)) AS i FROM r)),
x AS (SELECT c.query_id, claim, i, {_TOK.format('claim')} AS a, {_TOK.format('ev')} AS b FROM c JOIN d USING (query_id)), y AS (SELECT query_id, claim, i, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS j FROM x)
SELECT query_id, claim, CAST(i - 1 AS INTEGER) AS doc_no, round(j, 6) AS jaccard FROM y WHERE j >= 0.2""")
def jaccard_pairs(t):
    r = _rag(t).select("query_id", F.explode(text.sentences(F.coalesce("rag_response", F.lit("")))).alias("claim"), "retrieved_context")
    p = r.select("query_id", "claim", F.posexplode("retrieved_context").alias("doc_no", "d"))
    tok = lambda c: F.array_distinct(text.kg_tokens(F.coalesce(c, F.lit(""))))
    p = p.withColumn("j", text.jaccard(tok("claim"), tok("d.text"))).where("j >= 0.2")
    return p.select("query_id", "claim", "doc_no", F.round("j", 6).alias("jaccard"))


def _labels(t):
    """Stand-in labels by position: claim + document number modulo 4, with an unknown spelling."""
    r = _rag(t)
    c, e = text.sentences(F.coalesce("rag_response", F.lit(""))), F.transform(F.coalesce("retrieved_context", F.array()), lambda d: F.coalesce(d["text"], F.lit("")))
    name = lambda i, j: F.element_at(F.array(F.lit("Entailment"), F.lit("neutral"), F.lit("CONTRADICTION"), F.lit("odd")), ((i + j) % 4 + 1).cast("int"))
    grid = F.transform(c, lambda _, i: F.transform(e, lambda _d, j: name(i, j)))
    return r.select("query_id", c.alias("claims"), e.alias("evidence"), grid.alias("labels"))


@query(f"""WITH {_RAG}, s AS (SELECT query_id, {_sent('rag_response')} AS c, list_transform(coalesce(retrieved_context, []), lambda d: coalesce(d.text, '')) AS e FROM r),
k AS (SELECT query_id, e, c[i] AS claim, i - 1 AS ci, row_number() OVER (PARTITION BY query_id, lower(c[i]) ORDER BY i) AS n FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM s)),
p AS (SELECT query_id, ci, j - 1 AS di, claim, {NORM('e[j]')} AS ev FROM (SELECT *, unnest(range(1, len(e) + 1)) AS j FROM k WHERE n = 1)),
l AS (SELECT *, CASE (ci + di) % 4 WHEN 0 THEN 'entailed' WHEN 1 THEN 'neutral' WHEN 2 THEN 'contradicted' END AS label FROM p WHERE length(ev) >= 40)
SELECT query_id, CAST(ci AS INTEGER) AS claim_no, CAST(di AS INTEGER) AS doc_no, label, md5('Decide whether the EVIDENCE entails, contradicts, or is neutral to the CLAIM.' || chr(10) || 'Respond with one of: entailed | contradicted | neutral' || chr(10) || chr(10) || 'CLAIM:' || chr(10) || claim || chr(10) || chr(10) || 'EVIDENCE:' || chr(10) || ev || chr(10) || chr(10) || 'Label:') AS prompt_md5 FROM l WHERE label IS NOT NULL""")
def checker_pairs(t):
    p = claims.checker_pairs(_labels(t), "query_id", "claims", "evidence", "labels")
    return p.select("query_id", "claim_no", "doc_no", "label", F.md5("prompt").alias("prompt_md5"))


@query(f"""WITH {_RAG}, s AS (SELECT query_id, {_sent('rag_response')} AS c, list_filter(list_transform(coalesce(retrieved_context, []), lambda d: {NORM("coalesce(d.text, '')")}), lambda x: length(x) >= 40) AS e FROM r),
k AS (SELECT query_id, e, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS ci FROM (SELECT query_id, e, i, row_number() OVER (PARTITION BY query_id, lower(c[i]) ORDER BY i) AS n FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM s)) WHERE n = 1),
p AS (SELECT query_id, ci, j - 1 AS di FROM (SELECT query_id, ci, unnest(range(1, len(e) + 1)) AS j FROM k))
SELECT query_id, CAST(ci AS INTEGER) AS claim_no, CAST(di AS INTEGER) AS doc_no, CASE (ci + di) % 4 WHEN 0 THEN 'entailed' WHEN 1 THEN 'neutral' ELSE 'contradicted' END AS label FROM p WHERE (ci + di) % 4 < 3""")
def checker_pairs_compat(t):
    """The misaligned variant: positions count deduplicated claims and long-enough evidence only."""
    return claims.checker_pairs(_labels(t), "query_id", "claims", "evidence", "labels", compat=True).select("query_id", "claim_no", "doc_no", "label")


@query("""WITH l AS (SELECT DISTINCT query_id, [query_id, upper(query_id), query_id || 'x'] AS keys FROM rag_rows WHERE query_id IS NOT NULL)
SELECT query_id, CAST(i - 1 AS INTEGER) AS doc_no, CASE i WHEN 1 THEN 'Entailment' WHEN 2 THEN 'Neutral' END AS label FROM (SELECT query_id, unnest(range(1, 4)) AS i FROM l)""")
def label_align(t):
    """Label tables keyed by document: an exact key, one in another letter case, one that is missing."""
    r = t("rag_rows").where("query_id IS NOT NULL").select("query_id").distinct()
    keys = F.array("query_id", F.upper("query_id"), F.concat("query_id", F.lit("x")))
    labels = F.create_map("query_id", F.lit("Entailment"), F.concat(F.upper("query_id")), F.lit("Neutral"))
    return r.select("query_id", F.posexplode_outer(claims.align(keys, labels)).alias("doc_no", "label"))


@query(f"""WITH {_RAG} SELECT query_id, {NORM("coalesce(query, '')")} AS question, md5({NORM("CASE WHEN length(" + STRIP("coalesce(rag_response, '')") + ") >= 10 THEN rag_response ELSE coalesce(gt_answer, '') END")}) AS answer_md5 FROM r
WHERE length({STRIP("CASE WHEN length(" + STRIP("coalesce(rag_response, '')") + ") >= 10 THEN rag_response ELSE coalesce(gt_answer, '') END")}) >= 10 OR length({STRIP("coalesce(query, '')")}) >= 1""")
def infer_inputs(t):
    i = claims.infer_inputs(_rag(t), "query_id", "query", "rag_response", "gt_answer")
    return i.select("query_id", "question", F.md5("answer").alias("answer_md5"))


@query(f"WITH {_RAG}, s AS (SELECT query_id, {_sent('gt_answer')} AS c FROM r) SELECT query_id, CAST(len(list_distinct(list_transform(c, lambda x: lower(x)))) AS INTEGER) AS n_claims FROM s WHERE len(c) > 0")
def claims_rows(t):
    c = claims.distinct_claims(text.sentences(F.coalesce("gt_answer", F.lit(""))))
    return _rag(t).select("query_id", F.size(c).alias("n_claims")).where("n_claims > 0")


@query(f"""WITH {_RAG}, s AS (SELECT query_id, coalesce(query, '') AS q, CASE WHEN length({STRIP("coalesce(rag_response, '')")}) >= 10 THEN rag_response ELSE coalesce(gt_answer, '') END AS a FROM r)
SELECT query_id, '[["' || query_id || '", "asks", "x, y"]]' AS output, md5('You are an information extraction assistant. Extract factual triples from the given answer.' || chr(10) || 'Return a pure JSON array of triples as [[subject, relation, object], ...].' || chr(10) || 'Do not include explanations.' || chr(10) || chr(10) || 'Question:' || chr(10) || q || chr(10) || chr(10) || 'Answer:' || chr(10) || a || chr(10)) AS instruction_md5 FROM s
WHERE length({STRIP('a')}) >= 10 OR length({STRIP('q')}) >= 1""")
def extractor_rows(t):
    r = _rag(t).withColumn("g", F.array(F.array("query_id", F.lit("asks"), F.lit("x, y")))).withColumn("p", F.array().cast("array<array<string>>"))
    return claims.extractor_rows(r, "query", "rag_response", "gt_answer", "g", "p").select("query_id", "output", F.md5("instruction").alias("instruction_md5"))


_SHAPES = ['{"response_claims":[["a","r","b"],"plain",["x","y"]]}', '{"response_claims":[],"claims":["z"]}', '{"claims":["p ","q"]}', '{"response_claims":[["a",null,"b"],["",  "r", "o"]]}', "{bad", '{"atomic_claims":[1, "w"]}']


@query("""SELECT * FROM (VALUES (0, 'a r b|plain|x y', 'a r b.|plain|["x","y"]', 1), (1, '', '', 0), (2, 'p|q', '', 0), (3, 'a b|r o', 'a None b.| r o.', 1), (4, '', '', 0), (5, '1|w', '', 0)) v(rec, texts, sentences, n_triples)""")
def claims_shapes(t):
    """Literal records in every accepted shape: texts, sentences and valid triples."""
    d = t("region").sparkSession.createDataFrame(list(enumerate(_SHAPES)), "rec int, line string").withColumn("v", F.try_parse_json("line"))
    c = F.try_variant_get("v", "$.response_claims", "variant")
    joined = lambda x: F.coalesce(F.array_join(x, "|"), F.lit(""))
    return d.select("rec", joined(claims.shaped(F.col("v"))).alias("texts"), joined(claims.coerce(c)).alias("sentences"), F.size(claims.triples(c)).alias("n_triples"))


@query(f"SELECT query_id, CAST(i - 1 AS INTEGER) AS doc_no, coalesce(nullif({NORM('retrieved_context[i].text')}, ''), '') AS evidence, coalesce(nullif(trim(retrieved_context[i].doc_id), ''), nullif(trim(retrieved_context[i].title), '')) AS match_key FROM (SELECT DISTINCT query_id, retrieved_context, unnest(range(1, len(retrieved_context) + 1)) AS i FROM rag_rows WHERE query_id IS NOT NULL) WHERE nullif({NORM('retrieved_context[i].text')}, '') IS NOT NULL")
def evidence_text(t):
    """Evidence and key of each retrieved record, read as a loosely shaped record."""
    r = t("rag_rows").where("query_id IS NOT NULL").select("query_id", "retrieved_context").distinct()
    d = r.select("query_id", F.posexplode("retrieved_context").alias("doc_no", "d")).withColumn("v", F.parse_json(F.to_json("d")))
    return d.where(F.nullif(text.norm("d.text"), F.lit("")).isNotNull()).select("query_id", "doc_no", claims.evidence_text(F.col("v")).alias("evidence"), claims.match_key(F.col("v")).alias("match_key"))


_EVALS = ["/runs/eval_medquad-4.1-Gen3-8B/medquad_train.Gen3-8B.gen100__t/text_eval/results_text.json", "/runs/eval_medquad-4o/x/text_eval/results_text.json", "/a/b/c/d/results_text.json"]
_NAMES = ["student_checker_claim_probs__checker_sft_med-8b__kgfused_beta0.8.json", "student_checker_claim_probs__checker_grpo_base_model.json", "other.json", "x__kgfused__kgfused.json"]


@query("SELECT * FROM (VALUES (0, 'medquad', '4.1', 'Gen3-8B', 'medquad_train', 'Gen3-8B'), (1, 'medquad', '4o', 'unknown', 'x', 'unknown'), (2, '', 'unknown', 'unknown', 'c', 'unknown')) v(i, dataset, teacher, generator, dataset_split, run_generator)")
def path_metadata(t):
    d = t("region").sparkSession.createDataFrame(list(enumerate(_EVALS)), "i int, path string")
    return d.select("i", *paths.run_columns(F.col("path")))


@query("SELECT * FROM (VALUES (0, 'med-8b', 'sft', TRUE, 'student_checker_claim_probs__checker_sft_med-8b__kgfused_beta0.8'), (1, 'base_model.json', 'grpo', FALSE, 'student_checker_claim_probs__checker_grpo_base_model'), (2, 'unknown', 'unknown', FALSE, 'other'), (3, 'unknown', 'unknown', TRUE, 'x')) v(i, model, method, is_fused, stem)")
def fused_skip(t):
    d = t("region").sparkSession.createDataFrame(list(enumerate(_NAMES)), "i int, name string")
    return d.select("i", *paths.file_columns(F.col("name")))


@query("""WITH u AS (SELECT id, arg_max(question, coalesce(epoch_us(loaded_at), 0)) AS question FROM qa_items WHERE id IS NOT NULL GROUP BY id), g AS (SELECT query_id, count(*) AS n_claims, count(gold_label) AS n_gold FROM student_claims_flat WHERE query_id IS NOT NULL GROUP BY query_id), """ + _RAG + """
SELECT u.id, question, n_claims, n_gold, r.query_id IS NOT NULL AS has_response, CASE WHEN n_gold > 0 THEN 'gt_claims' WHEN n_claims > 0 THEN 'teacher_claims' WHEN r.query_id IS NOT NULL THEN 'response' END AS target FROM u LEFT JOIN g ON g.query_id = u.id LEFT JOIN r ON r.query_id = u.id""")
def unified_eval_join(t):
    """Left joins with the last duplicate of each side, and the best target that an item has."""
    u = t("qa_items").where("id IS NOT NULL").groupBy("id").agg(F.max_by("question", F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(0))).alias("question"))
    g = t("student_claims_flat").where("query_id IS NOT NULL").groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n_claims"), F.count("gold_label").alias("n_gold"))
    r = _rag(t).select(F.col("query_id").alias("id"), F.lit(True).alias("has_response"))
    j = u.join(g, "id", "left").join(r, "id", "left").withColumn("has_response", F.coalesce("has_response", F.lit(False)))
    target = F.when(F.col("n_gold") > 0, "gt_claims").when(F.col("n_claims") > 0, "teacher_claims").when(F.col("has_response"), "response")
    return j.select("id", "question", "n_claims", "n_gold", "has_response", target.alias("target"))


def _keyed(t):
    return t("student_claims_flat").where("query_id IS NOT NULL AND claim_idx IS NOT NULL").groupBy("query_id", "claim_idx").agg(F.max(text.label_strict("teacher_label")).alias("label"))


_KEYED = f"k AS (SELECT query_id, claim_idx, max(CASE lower({STRIP('teacher_label')}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.STRICT_LABELS.items()) + " END) AS label FROM student_claims_flat WHERE query_id IS NOT NULL AND claim_idx IS NOT NULL GROUP BY 1, 2)"
_RANKED = _KEYED + ", x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(query_id || '#' || CAST(claim_idx AS VARCHAR))) AS r, count(*) OVER (PARTITION BY label) AS size FROM k WHERE label IS NOT NULL)"


def _key():
    return F.concat("query_id", F.lit("#"), F.col("claim_idx").cast("string"))


@query("WITH " + _RANKED + " SELECT query_id, claim_idx, label FROM x WHERE r <= (SELECT min(size) FROM x)")
def rebalance_down(t):
    return ranking.rebalance(_keyed(t), "label", _key(), "down", text.LABELS).select("query_id", "claim_idx", "label")


@query("WITH " + _RANKED + ", y AS (SELECT *, (SELECT max(size) FROM x) AS m FROM x) SELECT query_id, claim_idx, label, CAST(unnest(range(1, CAST(floor(m / size) AS BIGINT) + CAST(r <= m % size AS BIGINT) + 1)) AS INTEGER) AS copy FROM y")
def rebalance_up(t):
    return ranking.rebalance(_keyed(t), "label", _key(), "up", text.LABELS).select("query_id", "claim_idx", "label", "copy")


@query("WITH " + _KEYED + ", x AS (SELECT *, row_number() OVER (ORDER BY md5(query_id || '#' || CAST(claim_idx AS VARCHAR))) AS r, count(*) OVER () AS n FROM k) SELECT query_id, claim_idx, CASE WHEN r <= greatest(1, floor(n * 0.95)) THEN 'train' ELSE 'eval' END AS part FROM x")
def split_95_5(t):
    return ranking.split_share(_keyed(t), _key(), 0.95).select("query_id", "claim_idx", "part")


def _texts():
    return F.transform(F.coalesce("retrieved_context", F.array()), lambda d: d["text"])


_PACK = f"""WITH RECURSIVE {_RAG}, b AS (SELECT query_id, coalesce(query, '') AS q, coalesce(retrieved_context, []) AS d, {4 * (1024 - 128 - 256 + 1) - 1 - context.PROMPT_CHARS} - length(coalesce(query, '')) AS room FROM r),
p AS (SELECT query_id, 0 AS i, CAST([] AS VARCHAR[]) AS kept, CAST(0 AS BIGINT) AS used, FALSE AS done, q, d, room FROM b
  UNION ALL SELECT query_id, i + 1, CASE WHEN done THEN kept WHEN length(t) <= room - used - head THEN list_append(kept, t) WHEN greatest(0, room - used - head) > 0 AND length(t) > 0 THEN list_append(kept, substr(t, 1, CAST(room - used - head AS INTEGER))) ELSE kept END,
    CASE WHEN NOT done AND length(t) <= room - used - head THEN used + head + length(t) ELSE used END, done OR length(t) > room - used - head, q, d, room
    FROM (SELECT *, substr(coalesce(d[i + 1].text, ''), 1, 1200) AS t, CASE WHEN len(kept) > 0 THEN 4 ELSE 2 END AS head FROM p WHERE i < least(8, len(d)))),
z AS (SELECT query_id, q, d, CASE WHEN greatest(1, ({context.PROMPT_CHARS} + length(q)) // 4) >= 640 THEN [] ELSE kept END AS kept FROM p WHERE i = least(8, len(d))),
u AS (SELECT *, greatest(1, ({context.PROMPT_CHARS} + length(q) + coalesce(list_sum(list_transform(kept, lambda x: length(x) + 4)), 0)) // 4) AS used, list_filter(range(1, len(d) + 1), lambda n: greatest(1, ({context.PROMPT_CHARS} + length(q) + list_sum(list_transform(d[1:n], lambda x: length(coalesce(x.text, '')) + 2)) + 2 * (n - 1)) // 4) <= 832) AS fit,
  list_filter(list_transform(range(1, least(8, len(d)) + 1), lambda i: CASE WHEN {STRIP("coalesce(d[i].text, '')")} <> '' THEN '[Doc ' || i || ']' || chr(10) || substr({STRIP('d[i].text')}, 1, 1200) END), lambda x: x IS NOT NULL) AS blocks FROM z)
SELECT query_id, CAST(len(kept) AS INTEGER) AS n_packed, md5(coalesce(array_to_string(kept, '|'), '')) AS packed_md5, md5(coalesce(array_to_string(blocks, chr(10) || chr(10)), '')) AS numbered_md5, CAST(coalesce(list_max(fit), 0) AS INTEGER) AS n_trimmed, CAST(greatest(1, least(128, greatest(0, 1023 - used))) AS INTEGER) AS max_tokens, used > 640 AS skipped FROM u"""


@query(_PACK)
def context_packing(t):
    """Texts that fit a small budget, numbered blocks, the longest run under a hard limit, generation budget, overflow."""
    r = _rag(t).withColumn("q", F.coalesce("query", F.lit("")))
    packed = context.pack(F.col("q"), _texts(), 1024, 128, 256, 8, 1200)
    used = context.prompt_tokens(F.col("q"), F.aggregate(packed, F.lit(0), lambda s, x: s + F.length(x) + 4))
    return r.select(
        "query_id", F.size(packed).alias("n_packed"), F.md5(F.array_join(packed, "|")).alias("packed_md5"), F.md5(context.pack_numbered(_texts())).alias("numbered_md5"), F.size(context.trim_to_limit(F.col("q"), _texts(), 1024, 128)).alias("n_trimmed"),
        context.completion_budget(1024, 128, used).alias("max_tokens"), context.overflow(1024, 128, 256, used).alias("skipped"),
    )


@query(f"WITH {_RAG} SELECT query_id, CAST(greatest(1, length(coalesce(rag_response, '')) // 4) AS INTEGER) AS n_tokens, greatest(1, length(coalesce(rag_response, '')) // 4) > 80 AS overflow, round(length(coalesce(rag_response, '')) / 4.0, 1) AS exact FROM r")
def overflow_skip(t):
    n = text.token_estimate(F.coalesce("rag_response", F.lit("")))
    return _rag(t).select("query_id", n.alias("n_tokens"), context.overflow(1024, 128, 816, n).alias("overflow"), F.round(F.length(F.coalesce("rag_response", F.lit(""))) / 4.0, 1).alias("exact"))


_CM = f"""WITH {_RAG}, gold AS (SELECT query_id, unnest({_sent('gt_answer')}) AS g FROM r), ch AS (SELECT query_id, i AS rank, coalesce(retrieved_context[i].text, '') AS ev FROM (SELECT query_id, retrieved_context, unnest(range(1, len(retrieved_context) + 1)) AS i FROM r)),
z AS (SELECT gold.query_id, g, rank, {_TOK.format('g')} AS a, {_TOK.format('ev')} AS b FROM gold JOIN ch USING (query_id)), e AS (SELECT query_id, g, rank, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END >= 0.12 AS hit FROM z),
gn AS (SELECT query_id, rank, count(*) FILTER (WHERE hit) AS gain FROM e GROUP BY 1, 2), gc AS (SELECT query_id, count(*) AS n_gold, count(*) FILTER (WHERE any_hit) AS covered FROM (SELECT query_id, g, bool_or(hit) AS any_hit FROM e GROUP BY 1, 2) GROUP BY 1),
id AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS i FROM gn)
SELECT query_id, round((SELECT avg(CAST(gain > 0 AS DOUBLE)) FROM gn WHERE gn.query_id = gc.query_id AND rank <= 3), 6) AS context_precision, round(covered / n_gold, 6) AS claim_recall, round(coalesce((SELECT sum(gain / log2(rank + 1)) FROM gn WHERE gn.query_id = gc.query_id AND rank <= 3) / nullif((SELECT sum(gain / log2(i + 1)) FROM id WHERE id.query_id = gc.query_id AND i <= 3), 0), 0), 6) AS ndcg,
round(coalesce((SELECT count(*) FROM gn WHERE gn.query_id = gc.query_id AND rank <= 3 AND gain > 0) / nullif((SELECT count(*) FROM gn WHERE gn.query_id = gc.query_id AND gain > 0), 0), 0), 6) AS recall_at_k FROM gc"""


@query(_CM)
def context_metrics(t):
    """Precision, claim recall, recall@3 and nDCG@3 of the retrieved texts; a text entails a gold claim at token Jaccard 0.12."""
    tok = lambda c: F.array_distinct(text.kg_tokens(F.coalesce(c, F.lit(""))))
    g = _rag(t).select("query_id", F.explode(text.sentences(F.coalesce("gt_answer", F.lit("")))).alias("g"), "retrieved_context")
    e = g.select("query_id", "g", F.posexplode("retrieved_context").alias("p", "d")).withColumn("rank", F.col("p") + 1).withColumn("hit", text.jaccard(tok("g"), tok("d.text")) >= 0.12)
    gains = e.groupBy("query_id", "rank").agg(F.count_if("hit").alias("gain"))
    cov = e.groupBy("query_id", "g").agg(F.bool_or("hit").alias("h")).groupBy("query_id").agg(F.count("*").alias("n_gold"), F.count_if("h").alias("gold_covered"))
    c = cov.select("query_id", "gold_covered", "n_gold", *(F.lit(0).alias(x) for x in ("supported", "refuted", "used", "n_claims")))
    m = metrics.context_metrics(c, gains, "query_id", 3)
    return m.select("query_id", *(F.round(x, 6).alias(x) for x in ("context_precision", "claim_recall", "ndcg", "recall_at_k")))
