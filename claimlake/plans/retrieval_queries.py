"""Queries on retrieval, fusion of rankings and unified rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlake.functions import text
from claimlake.operators import retrieval, unify
from claimlake.plans.registry import query
from claimlake.plans.text_queries import STRIP


def _asked(t):
    """The query set of a search: documents whose id is divisible by 50, asked by focus and type."""
    q = F.concat_ws(" ", "question_focus", "question_type")
    return t("documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), q.alias("q"))


def _bm25(t, k):
    return retrieval.bm25(_asked(t), "qid", "q", t("documents"), "doc_id", "text", k)


def _bm25_sql(k):
    return f"""
toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{text.BM25_TOKEN}') AS t FROM documents),
posts AS (SELECT token, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM toks) GROUP BY ALL),
stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks),
raw AS (SELECT token, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM posts, stats GROUP BY token),
w AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT qid, token, count(*) AS qn FROM (SELECT doc_id AS qid, unnest(regexp_extract_all(lower(concat_ws(' ', question_focus, question_type)), '{text.BM25_TOKEN}')) AS token FROM documents WHERE doc_id % 50 = 0) GROUP BY ALL),
scored AS (SELECT qid, doc_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN posts USING (token) JOIN w USING (token), stats GROUP BY qid, doc_id),
bm AS (SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) WHERE rank <= {k})"""


@query("WITH " + _bm25_sql(10) + " SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(t):
    return _bm25(t, 10).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{text.BM25_TOKEN}') AS t FROM documents),
posts AS (SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM toks) GROUP BY ALL)
SELECT token, count(*) AS df, sum(tf) AS cf, round(ln((SELECT count(*) FROM toks) - count(*) + 0.5) - ln(count(*) + 0.5), 6) AS raw_idf FROM posts GROUP BY token""")
def bm25_statistics(t):
    p = retrieval.postings(t("documents"), "doc_id", "text")
    n = retrieval.lengths(t("documents"), "doc_id", "text")
    s = p.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(n))  # one row
    return s.select("token", "df", "cf", F.round(F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5), 6).alias("raw_idf"))


_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"""SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS qid, b.vec_id, {_DOT} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 9) DESC, b.vec_id) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 10""")
def dense_topk(t):
    e = t("embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return retrieval.dense(q, "qid", "qv", e, "vec_id", "embedding", 10).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT label, vec_id, rank, round(score, 6) AS score FROM (SELECT e.label, e.vec_id, CAST(e.embedding[1] AS DOUBLE) AS score, row_number() OVER (PARTITION BY e.label ORDER BY e.embedding[1] DESC, e.vec_id) AS rank FROM embeddings e) WHERE rank <= 5")
def topk_entities(t):
    from claimlake.operators.ranking import top_k

    e = t("embeddings").select("label", "vec_id", F.element_at("embedding", 1).cast("double").alias("score"))
    return top_k(e, ["label"], 5, F.desc("score"), F.asc("vec_id")).select("label", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _vectors(t):
    """A vector of its own for each document: one embedding of the whole table plus a little of another."""
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = e.agg(F.count("*").alias("n"))
    d = t("documents").select("doc_id").crossJoin(F.broadcast(n))  # one row
    d = d.select("doc_id", F.pmod("doc_id", "n").alias("x"), F.pmod(F.floor(F.col("doc_id") / F.col("n")), F.col("n")).alias("y"))
    d = d.join(e.select(F.col("vec_id").alias("x"), F.col("e").alias("ex")), "x").join(e.select(F.col("vec_id").alias("y"), F.col("e").alias("ey")), "y")
    return d.select("doc_id", F.zip_with("ex", "ey", lambda a, b: a + 0.1 * b).alias("embedding"))


def _dense(t, k):
    v = _vectors(t)
    return retrieval.dense(v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("qv")), "qid", "qv", v, "doc_id", "embedding", k)


_DENSE_SQL = """
v AS (SELECT doc_id, list_transform(list_zip(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), lambda z: z[1] + 0.1 * z[2]) AS e
  FROM documents, (SELECT count(*) AS n FROM embeddings) JOIN embeddings x ON x.vec_id = doc_id % n JOIN embeddings y ON y.vec_id = (doc_id // n) % n),
de AS (SELECT qid, doc_id, score, rank FROM (SELECT a.doc_id AS qid, b.doc_id, list_inner_product(a.e, b.e) AS score, row_number() OVER (PARTITION BY a.doc_id ORDER BY round(list_inner_product(a.e, b.e), 9) DESC, b.doc_id) AS rank FROM v a, v b WHERE a.doc_id % 50 = 0) WHERE rank <= {k})"""


@query("WITH " + _bm25_sql(500) + "," + _DENSE_SQL.format(k=200) + """,
n1 AS (SELECT qid, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-8 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM de WINDOW w AS (PARTITION BY qid)),
n2 AS (SELECT qid, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-8 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM bm WINDOW w AS (PARTITION BY qid)),
h AS (SELECT qid, doc_id, 0.65 * coalesce(n1.s, 0) + 0.35 * coalesce(n2.s, 0) AS score FROM n1 FULL JOIN n2 USING (qid, doc_id))
SELECT qid, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM h) WHERE rank <= 10""")
def hybrid_topk(t):
    return retrieval.hybrid(_dense(t, 200), _bm25(t, 500), "qid", "doc_id", 0.65, 10).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def _rrf(t):
    w = retrieval.weights("bm25=1.0,dense=1.2")
    b = _bm25(t, 10).withColumn("weight", F.lit(w["bm25"])).withColumn("run_no", F.lit(0))
    d = _dense(t, 10).withColumn("weight", F.lit(w["dense"])).withColumn("run_no", F.lit(1))
    return retrieval.reciprocal_rank(b.unionByName(d), "qid", "doc_id", 10)


_RRF_SQL = "WITH " + _bm25_sql(10) + "," + _DENSE_SQL.format(k=10) + """,
runs AS (SELECT qid, doc_id, score, rank, 1.0 AS weight, 0 AS run_no FROM bm UNION ALL SELECT qid, doc_id, score, rank, 1.2, 1 FROM de),
f AS (SELECT qid, doc_id, sum(weight / (60 + rank)) AS rrf, arg_min(score, run_no * 1000 + rank) AS score, min(run_no * 1000 + rank) AS first FROM runs GROUP BY qid, doc_id),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, first, doc_id) AS rank FROM f) WHERE rank <= 10)"""


@query(_RRF_SQL + " SELECT qid, doc_id, round(rrf, 6) AS rrf_score, round(score, 6) AS score, rank FROM rr")
def rrf_fusion(t):
    return _rrf(t).select("qid", "doc_id", F.round("rrf_score", 6).alias("rrf_score"), F.round("score", 6).alias("score"), "rank")


@query(_RRF_SQL + " SELECT qid, CAST(rank - 1 AS INTEGER) AS pos, CAST(doc_id AS VARCHAR) AS doc_id, coalesce(question_focus, '') AS title, coalesce(source, '') AS source, md5(coalesce(text, '')) AS text_md5 FROM rr JOIN documents USING (doc_id)")
def rag_rows(t):
    rows = retrieval.hits_to_rows(_rrf(t), "qid", "doc_id", t("documents"), "text", "question_focus", "source")
    flat = rows.select("qid", F.posexplode("retrieved_context").alias("pos", "h"))
    return flat.select("qid", "pos", "h.doc_id", "h.title", "h.source", F.md5("h.text").alias("text_md5"))


@query("SELECT id, 'csiro-gold-' || CAST(i AS VARCHAR) AS doc_id, md5(contexts[i]) AS text_md5 FROM (SELECT DISTINCT id, contexts, i FROM (SELECT id, contexts, unnest(range(1, len(contexts) + 1)) AS i FROM qa_items WHERE dataset = 'csiro'))")
def gold_contexts(t):
    q = t("qa_items").where("dataset = 'csiro'").select("id", "contexts").dropDuplicates(["id", "contexts"])
    return q.select("id", F.explode(unify.gold_hits(F.col("contexts"))).alias("h")).select("id", "h.doc_id", F.md5("h.text").alias("text_md5"))


@query(f"""SELECT 'qiaojin/PubMedQA' AS dataset, id, coalesce(question, '') AS question, CAST(len(coalesce(contexts, [])) AS INTEGER) AS n_contexts, coalesce(answer, '') AS answer, nullif(label, '') AS label FROM qa_items WHERE dataset = 'pubmedqa'
UNION ALL SELECT 'lavita/MedQuAD', id, coalesce(question, ''), 0, coalesce(answer, ''), NULL FROM qa_items WHERE dataset = 'medquad'
UNION ALL SELECT 'hyesunyun/liveqa_medical_trec2017', id, CASE WHEN trim(coalesce(question, '')) <> '' THEN trim(question) ELSE id END, 1, coalesce(answer, ''), NULL FROM qa_items WHERE dataset = 'liveqa'
UNION ALL SELECT 'csiro/medredqa_pubmed', id, {STRIP('coalesce(question, \'\')')}, CAST({STRIP('coalesce(contexts[1], \'\')')} <> '' AS INTEGER), {STRIP('coalesce(answer, \'\')')}, NULL FROM qa_items WHERE dataset = 'csiro'""")
def qa_unify(t):
    q = t("qa_items")
    raw = lambda d, *cs: q.where(F.col("dataset") == d).select(F.parse_json(F.to_json(F.struct(*cs))).alias("v"))
    a = unify.abstracts(raw("pubmedqa", F.col("id").alias("pubid"), F.col("question").alias("QUESTION"), F.when(F.col("contexts").isNotNull(), F.struct("contexts")).alias("context"), F.col("answer").alias("long_answer"), F.col("label").alias("final_decision")), "v", "pqa_labeled")
    p = unify.pages(raw("medquad", F.col("id").alias("question_id"), "question", "answer"), "v")
    refs = F.array(F.struct(F.col("answer").alias("ANSWER"), F.lit("https://a.example").alias("AnswerURL"))).alias("REFERENCE_ANSWERS")
    v = unify.live(raw("liveqa", F.col("id").alias("QUESTION_ID"), F.col("question").alias("NIST_PARAPHRASE"), F.lit("s").alias("NLM_SUMMARY"), refs), "v")
    # the id stands for the position in the file
    c = q.where("dataset = 'csiro'").select("id", F.parse_json(F.to_json(F.struct("question", F.get("contexts", F.lit(0)).alias("document"), F.col("answer").alias("response")))).alias("v"))
    u = a.unionByName(p).unionByName(v).unionByName(unify.local(c, "v", "id", "test"))
    return u.select("dataset", "id", "question", F.size("contexts").alias("n_contexts"), "answer", "label")


_FLIPPED = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings UNION ALL SELECT -1 - vec_id, list_concat([-CAST(embedding[1] AS DOUBLE)], CAST(embedding[2:] AS DOUBLE[])) FROM embeddings)"""


@query(f"WITH {_FLIPPED} SELECT a.id AS a, b.id AS b, round(list_inner_product(a.e, b.e), 6) AS cosine FROM v a, v b WHERE a.id < b.id AND list_inner_product(a.e, b.e) >= 0.95")
def near_vectors(t):
    """Pairs at cosine 0.95 by random projections, among all vectors and copies of them with the first coordinate's sign turned."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    turned = e.select((-1 - F.col("id")).alias("id"), F.transform("e", lambda x, i: F.when(i == 0, -x).otherwise(x)).alias("e"))
    return retrieval.near_vectors(e.unionByName(turned), "id", "e", 0.95).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT}, 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND {_DOT} >= 0.45")
def near_vectors_exact(t):
    """All pairs at a low cosine, tile against tile."""
    return retrieval.near_vectors(t("embeddings"), "vec_id", "embedding", 0.45, exact=True).select("a", "b", F.round("cosine", 6).alias("cosine"))
