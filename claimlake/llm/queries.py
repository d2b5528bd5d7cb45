"""Registered queries of the problems tagged llm, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm import bpe, defects, mixing, near_dup, spam, split_overlap, splitter


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    a = defects.rows_of(_t(spark, d, "qa_items"), "qa_items", "answer", "loaded_at")
    return a.unionByName(defects.rows_of(_t(spark, d, "qa_split_items"), "qa_split_items", "reference_answer", "released_at"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.found(_answers(spark, d))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return defects.label(_answers(spark, d)).withColumn("posterior", F.round("posterior", 6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.pairs(_t(spark, d, "qa_split_items"), 0.8)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.report(_t(spark, d, "qa_split_items"), 0.8)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = near_dup.pairs(_t(spark, d, "documents"), k=3, least=0.7)
    return out.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.groups(_t(spark, d, "documents"), k=3, least=0.7).withColumnRenamed("id", "doc_id")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitter.split(splitter.corpus_texts(_t(spark, d, "documents"), _t(spark, d, "qa_items")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the splitter cut: their second piece exists exactly if they are over the limit."""
    return _pieces(spark, d).where("piece = 1").select("rec_table", "rec_key", "pos").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_t(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Ids decoded again; same is true for every text."""
    docs = _t(spark, d, "documents")
    back = bpe.decode(bpe.encode(docs)).select("doc_id", F.md5("text").alias("back"))
    own = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("own"))
    return own.join(back, "doc_id").groupBy((F.col("own") == F.col("back")).alias("same")).agg(F.count("*").alias("n_docs"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.found(_t(spark, d, "documents")).select(F.col("id").alias("doc_id"))


def p9_by_language(spark: SparkSession, d: str) -> DataFrame:
    s = spam.score(_t(spark, d, "documents"))
    return s.groupBy("lang", "model").agg(F.count("*").alias("n_docs"), F.count_if(F.col("spam_share") > 0.5).alias("n_spam"), F.round(F.avg("spam_share"), 6).alias("mean_share"))


def p1_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """The label model of each defect with its validated cutoff."""
    return defects.cutoff_report(_answers(spark, d))


def p9_validation(spark: SparkSession, d: str) -> DataFrame:
    """Texts of known kind, made from every document, under several cutoffs and cosines."""
    return spam.validation(_t(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_labels": p1_labels,
    "p1_cutoffs": p1_cutoffs,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_by_language": p9_by_language,
    "p9_validation": p9_validation,
}

_PAIRS_SQL = """
    WITH q AS (SELECT DISTINCT id, CASE WHEN lower(trim(split)) = 'train' THEN 0 WHEN lower(trim(split)) IN ('validation', 'val', 'dev', 'test') THEN 1 END AS side, list_distinct(regexp_extract_all(strip_accents(lower(question)), '[\\p{L}\\p{N}]+')) AS w FROM qa_split_items),
    p AS (SELECT DISTINCT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM q a JOIN q b ON a.side = 0 AND b.side = 1 AND a.id <> b.id AND len(a.w) > 0 AND len(b.w) > 0
        AND len(a.w) >= 0.8 * len(b.w) AND len(b.w) >= 0.8 * len(a.w) AND len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))
"""

SQL: dict[str, str] = {
    "p2_found": _PAIRS_SQL + "SELECT id_a, id_b FROM p",
    "p2_report": _PAIRS_SQL
    + """, n AS (SELECT id, count(*) AS k FROM (SELECT id_a AS id FROM p UNION ALL SELECT id_b FROM p) GROUP BY id), e AS (SELECT DISTINCT id, dataset, lower(trim(split)) AS split FROM qa_split_items WHERE lower(trim(split)) IN ('validation', 'val', 'dev', 'test'))
    SELECT split, dataset, count(*) AS n_items, count(k) AS n_overlapping, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_pairs FROM e LEFT JOIN n USING (id) GROUP BY split, dataset""",
    "p3_found": """
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
        SELECT a AS doc_id_a, b AS doc_id_b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.7 * (x.n + y.n - c)
    """,
    "p3_groups": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS class FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.7 * (x.n + y.n - c)), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT DISTINCT a AS doc_id, a AS top FROM e UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.doc_id),
        k AS (SELECT e.a AS doc_id, count(DISTINCT y.class) FILTER (WHERE y.class <> x.class) + count(*) FILTER (WHERE y.class = x.class) AS n_links FROM e JOIN n x ON x.doc_id = e.a JOIN n y ON y.doc_id = e.b GROUP BY 1)
        SELECT r.doc_id, min(top) AS group_id, any_value(n_links) AS n_links FROM r JOIN k ON k.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "p4_found": """
        SELECT 'documents' AS rec_table, CAST(doc_id AS VARCHAR) AS rec_key, CAST(0 AS INTEGER) AS pos FROM documents WHERE length(text) > 2000
        UNION
        SELECT 'qa_items', id, CAST(p - 1 AS INTEGER) FROM (SELECT id, contexts, unnest(range(1, len(contexts) + 1)) AS p FROM qa_items) WHERE length(contexts[p]) > 2000
    """,
}
