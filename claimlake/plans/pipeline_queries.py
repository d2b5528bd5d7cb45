"""Queries that run the composed drivers whole over driver tables, with models replaced by deterministic stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlake.functions import text
from claimlake.operators import context
from claimlake.plans import pipelines, retrieval_queries
from claimlake.plans.distill_queries import _PACK, _labels, _rag
from claimlake.plans.eval_queries import _C, _STRICT
from claimlake.plans.metric_queries import _claims
from claimlake.plans.registry import SQL, query
from claimlake.plans.retrieval_queries import _RRF_SQL


@query(f"SELECT label, prompt_md5 FROM ({SQL['checker_pairs']})")
def distil_checker(t):
    """Checker pairs out of result documents, one a query, by the distillation driver; equals the operator on typed rows."""
    r = _labels(t)
    grid = F.transform("labels", lambda row: row)
    doc = F.struct(F.array(F.struct(F.col("query_id"), F.lit("q").alias("query"), F.lit("r").alias("response"), F.col("claims").alias("response_claims"), F.transform("evidence", lambda e: F.struct(e.alias("text"))).alias("retrieved_context"), grid.alias("retrieved2response"))).alias("results"))
    docs = r.select(F.col("query_id").alias("file"), F.parse_json(F.to_json(doc)).alias("v"))
    return pipelines.distillation(docs)["checker"].select("label", F.md5("prompt").alias("prompt_md5"))


@query(_RRF_SQL + ", q AS (SELECT doc_id AS id FROM documents WHERE doc_id % 50 = 0) SELECT CAST(q.id AS VARCHAR) AS query_id, '' AS rag_response, CAST(count(rr.doc_id) AS INTEGER) AS n_context, arg_min(CAST(rr.doc_id AS VARCHAR), rank) AS first_doc FROM q LEFT JOIN rr ON rr.qid = q.id GROUP BY q.id")
def rag_inputs(t):
    """Rows for a generator from two weighted legs; items without a hit keep an empty context."""
    leg = lambda h: h.select(F.col("qid").cast("string").alias("query_id"), "doc_id", "score", "rank")
    items = t("documents").where("doc_id % 50 = 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    docs = t("documents").select("doc_id", "text", F.col("question_focus").alias("title"), "source")
    r = pipelines.rag_inputs(items, {"bm25": leg(retrieval_queries._bm25(t, 10)), "dense": leg(retrieval_queries._dense(t, 10))}, docs, 10, "bm25=1.0,dense=1.2")
    return r.select("query_id", "rag_response", F.size("retrieved_context").alias("n_context"), F.try_element_at("retrieved_context", F.lit(1))["doc_id"].alias("first_doc"))


def _count_client():
    """Stands for a generator: answers with the number of characters of the prompt."""
    return lambda prompt: str(len(prompt))


@query(_PACK[: _PACK.rindex("SELECT query_id")] + f""", g AS (SELECT query_id, {context.PROMPT_CHARS} + length(q) + coalesce(list_sum(list_transform(kept, lambda x: length(x) + 2)), 0) + 2 * greatest(0, len(kept) - 1) AS chars FROM z)
SELECT query_id, CASE WHEN greatest(1, chars // 4) > 640 THEN '' ELSE CAST(CAST(chars AS BIGINT) AS VARCHAR) END AS rag_response, greatest(1, chars // 4) > 640 AS skipped FROM g""")
def generated_answers(t):
    """Packing, budget check and generation; prompts over the budget are skipped with an empty answer."""
    r = _rag(t).withColumn("rag_response", F.lit(None).cast("string"))
    a = pipelines.generate_answers(r, _count_client, 1024, 128, 256, 8, 1200)
    return a.select("query_id", "rag_response", F.col("_skipped_overflow").alias("skipped"))


def _spell_client():
    """Stands for a checker: answers in some spelling, read off the prompt's length."""
    words = ("Label: Entailed.", "neutral", "refuted by the text", "gibberish")
    return lambda prompt: words[len(prompt) % 4]


_READ = "CASE length(coalesce(claim_text, '')) % 4 WHEN 0 THEN 'entailed' WHEN 2 THEN 'contradicted' ELSE 'neutral' END"


@query(f"""WITH {_C}, d AS (SELECT {_STRICT('gold_label')} AS g, {_READ} AS p FROM c), k AS (SELECT g, p FROM d WHERE g IS NOT NULL)
SELECT count(*) AS n, round(avg(CAST(g = p AS DOUBLE)), 6) AS accuracy, count(*) FILTER (WHERE p = 'neutral') AS n_neutral, count(*) FILTER (WHERE g = 'contradicted' AND p = 'entailed') AS n_missed FROM k""")
def checker_evaluation(t):
    """Answers of a checker read into labels, what cannot be read as neutral, and how they agree with the gold labels."""
    c = _claims(t).select(F.coalesce("claim_text", F.lit("")).alias("prompt"), text.label_strict("gold_label").alias("label")).where("label IS NOT NULL")
    e = pipelines.evaluate_checker(c, _spell_client)
    rows = e["rows"].agg(F.count_if(F.col("pred") == "neutral").alias("n_neutral"), F.count_if((F.col("label") == "contradicted") & (F.col("pred") == "entailed")).alias("n_missed"))
    return e["summary"].select("n", F.round("accuracy", 6).alias("accuracy")).crossJoin(F.broadcast(rows))  # one row each


@query("""WITH d AS (SELECT doc_id, document_url AS url, length(text) // 10 + 1 AS n FROM documents WHERE document_url <> '' AND text IS NOT NULL), c AS (SELECT doc_id, url, n, CASE WHEN n <= 100 THEN 1 ELSE 1 + (n - 100 + 84) // 85 END AS k FROM d WHERE 10 * n - 1 >= 300), x AS (SELECT *, unnest(range(0, k)) AS j FROM c)
SELECT CAST(doc_id AS VARCHAR) || '#' || CAST(j AS VARCHAR) AS chunk_id, url, CAST(k AS INTEGER) AS num_chunks, md5(list_reduce(list_transform(range(85 * j + 1, least(n, 85 * j + 100) + 1), lambda i: lpad(CAST(i AS VARCHAR), 9, '0')), lambda a, b: a || ' ' || b)) AS text_md5 FROM x""")
def corpus_build(t):
    """Pages to a chunk table with vectors: visible text, least length, chunks with their numbers; words as in chunk_ordinals."""
    words = F.transform(F.sequence(F.lit(1), F.floor(F.length("text") / 10).cast("int") + 1), lambda i: F.lpad(i.cast("string"), 9, "0"))
    html = F.concat(F.lit("<html><style>x {y: z}</style><p>"), F.array_join(words, " "), F.lit("</p></html>"))
    pages = t("documents").where("text IS NOT NULL").select("doc_id", F.col("document_url").alias("url"), html.alias("html"))
    c = pipelines.build_corpus(pages.unionByName(pages), "doc_id", "url", "html")
    return c.where("size(vec) > 0").select("chunk_id", "url", "num_chunks", F.md5("text").alias("text_md5"))


