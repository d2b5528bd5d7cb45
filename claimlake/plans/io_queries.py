"""Queries that write driver tables in a format and read them back, in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimlake.operators import corpus, paths
from claimlake.plans.registry import query
from claimlake.runtime import checkpoint_dir
from claimlake.sources import datasets, readers, writers


def _folder(spark) -> str:
    """A new folder in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/claimlake-io-{uuid.uuid4().hex}"


_CUSTOMER = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
_CUSTOMER_DDL = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey < 5")
def io_jsonl(t):
    """JSON Lines: an overwriting and an appending write, read back strictly."""
    c, spark = t("customer"), t("customer").sparkSession
    path = _folder(spark)
    writers.jsonl(c.select(*_CUSTOMER), path)
    writers.jsonl(c.where("c_nationkey < 5").select(*_CUSTOMER), path, append=True)
    return readers.jsonl_strict(spark, path, _CUSTOMER_DDL)


@query("SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, n_name FROM nation")
def io_documents(t):
    """One JSON document a region under its own root, found recursively; broken and foreign files are left out."""
    n, spark = t("nation"), t("nation").sparkSession
    path = _folder(spark)
    for k in range(5):  # as many as regions, which are fixed
        writers.document(n.where(F.col("n_regionkey") == k), f"{path}/r{k}", ["n_nationkey"])
    spark.createDataFrame([("{bad",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/broken")
    r = readers.results(readers.documents(spark, path, "part-*"))
    get = lambda k, kind: F.try_variant_get("record", f"$.{k}", kind)
    return r.select(get("n_regionkey", "int").alias("region"), "pos", get("n_name", "string").alias("n_name"))


@query("SELECT r_regionkey % 2 AS half, count(*) AS n_rows FROM region GROUP BY 1 UNION ALL SELECT 9, 1")
def io_document_counts(t):
    """Rows of each readable file of two roots, and how many files were unreadable, which is reported and not an error."""
    r, spark = t("region"), t("region").sparkSession
    path = _folder(spark)
    for k in range(2):
        writers.document(r.where(F.col("r_regionkey") % 2 == k), f"{path}/half{k}", ["r_regionkey"])
    spark.createDataFrame([("{bad",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/half1/broken")
    c = readers.file_counts(spark, [f"{path}/half0", f"{path}/half1", f"{path}/half1"], "part-*")
    good = c.where("readable").select(F.regexp_extract("file", "half([01])", 1).cast("int").alias("half"), "n_rows")
    return good.unionByName(c.agg(F.lit(9).alias("half"), F.count_if(~F.col("readable")).alias("n_rows")))


@query("""WITH l AS (SELECT coalesce(line, '') AS line FROM run_lines), j AS (SELECT line, CASE WHEN json_valid(line) THEN line END AS v FROM l)
SELECT count(*) AS n_lines, count(*) FILTER (WHERE trim(line) <> '' AND v IS NULL) AS n_parse_err, count(*) FILTER (WHERE v IS NOT NULL AND json_extract_string(v, '$.run_no') IS NULL) AS n_missing_qid,
count(*) FILTER (WHERE json_extract_string(v, '$.run_no') IS NOT NULL AND NOT json_exists(v, '$.faithfulness') AND NOT json_exists(v, '$.fai')) AS n_missing_score FROM j""")
def io_counters(t):
    """Tolerant scan of lines: blank ones count, broken ones and those without key or score are counted."""
    r, spark = t("run_lines"), t("run_lines").sparkSession
    path = _folder(spark)
    r.select(F.coalesce("line", F.lit("")).alias("value")).write.text(path)
    c = readers.line_counters(readers.lines(spark, path), "run_no", "faithfulness", ("fai",))
    return c.agg(*(F.sum(x).alias(x) for x in ("n_lines", "n_parse_err", "n_missing_qid", "n_missing_score")))


@query("SELECT query_id, p_final, coalesce(node_hit, FALSE) AS node_hit, coalesce(pair_hit, FALSE) AS pair_hit FROM kge_scores WHERE query_id IS NOT NULL")
def io_scores(t):
    """Score rows as lines, read back from whichever member holds the score."""
    k, spark = t("kge_scores"), t("kge_scores").sparkSession
    path = _folder(spark)
    nan = F.when(~F.isnan("p_final"), F.col("p_final"))
    writers.jsonl(k.select("query_id", F.when(F.col("eid_head") % 2 == 0, F.col("p_final")).alias("p_final"), F.when(F.coalesce(F.col("eid_head") % 2, F.lit(1)) != 0, nan).alias("score"), "node_hit", "pair_hit"), path)
    return readers.scores(readers.lines(spark, path)).select("query_id", "p_final", "node_hit", "pair_hit")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS VARCHAR) AS id, 'csiro/medredqa_pubmed' AS dataset, n_name AS question, CAST(CASE WHEN n_regionkey = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_contexts, 'r' || CAST(n_regionkey AS VARCHAR) AS answer FROM nation")
def io_local_split(t):
    """A local split that is one JSON list; the position is the id, the document the one context."""
    n, spark = t("nation"), t("nation").sparkSession
    path = _folder(spark)
    doc = F.when(F.col("n_regionkey") == 0, F.lit(" ")).otherwise(F.concat(F.lit("doc of "), "n_name"))
    rows = n.orderBy("n_nationkey").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("question"), doc.alias("document"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("response"))).alias("j"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "j"))).alias("x"))  # 25 rows
    one.select(F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["j"]), ","), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return datasets.local_split(spark, path, "test").select("id", "dataset", "question", F.size("contexts").alias("n_contexts"), "answer")


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS pos, r_name FROM region UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER), n_name FROM nation WHERE n_regionkey = 1")
def io_rooted(t):
    """Flat claim files: a list, a list under ``root``; an object of another kind gives nothing."""
    spark = t("region").sparkSession
    path = _folder(spark)
    listed = lambda d, c, k: d.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, F.to_json(F.struct(F.col(c).alias("n"))).alias("j")))), lambda r: r["j"]), ",").alias("j"))  # noqa: E731 - fixed tables
    listed(t("region"), "r_name", "r_regionkey").select(F.concat(F.lit("["), "j", F.lit("]"))).coalesce(1).write.text(f"{path}/a")
    listed(t("nation").where("n_regionkey = 1"), "n_name", "n_nationkey").select(F.concat(F.lit('{"root": ['), "j", F.lit("]}"))).coalesce(1).write.text(f"{path}/b")
    spark.createDataFrame([('{"other": [1]}',)], "value string").coalesce(1).write.text(f"{path}/c")
    return readers.rooted(readers.documents(spark, path, "part-*")).select("pos", F.try_variant_get("record", "$.n", "string").alias("r_name"))


@query("SELECT raw_id, idx FROM entities WHERE raw_id IS NOT NULL")
def io_tsv(t):
    e, spark = t("entities").where("raw_id IS NOT NULL"), t("entities").sparkSession
    path = _folder(spark)
    e.select("raw_id", "idx").write.csv(path, sep="\t")
    return readers.tsv(spark, path)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def io_csv(t):
    """A summary as CSV with a header, all read back as text."""
    s, spark = t("supplier"), t("supplier").sparkSession
    path = _folder(spark)
    writers.csv(s.select("s_suppkey", "s_name", "s_nationkey"), path)
    return readers.csv(spark, path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS idx, CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) / 4 AS b FROM nation")
def io_npy(t):
    """The matrix of an array file, read in row ranges."""
    import os

    import numpy as np

    n, spark = t("nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").toPandas(), t("nation").sparkSession  # 25 rows
    folder = _folder(spark).removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    np.save(f"{folder}/m.npy", np.stack([n.n_nationkey.to_numpy(np.float32), n.n_regionkey.to_numpy(np.float32) / 4], axis=1))
    return readers.npy(spark, f"{folder}/m.npy").select("idx", F.get("vec", F.lit(0)).cast("double").alias("a"), F.get("vec", F.lit(1)).cast("double").alias("b"))


@query("SELECT * FROM (VALUES ('/a', '/a/x_max.jsonl'), ('/b', '/b/p1.jsonl'), ('/c', '/c/q.jsonl')) v(folder, file)")
def io_preferred(t):
    """The score file of each folder: the first pattern that matches any, of its files the first by name."""
    files = ["/a/x_max.jsonl", "/a/p1.jsonl", "/b/p2.jsonl", "/b/p1.jsonl", "/b/z.txt", "/c/q.jsonl", "/d/z.txt"]
    return readers.preferred_file(t("region").sparkSession.createDataFrame([(f,) for f in files], "file string"), ["*_max.jsonl", "p*.jsonl", "*.jsonl"])


@query("SELECT CAST(doc_id AS BIGINT) AS row_id, md5(text) AS text_md5, source, CAST(length(text) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL AND text <> ''")
def io_index(t):
    """An index table of texts, metadata and vectors, written and opened again."""
    from claimlake.functions import models

    d, spark = t("documents").where("text <> ''"), t("documents").sparkSession
    path = _folder(spark)
    writers.index(models.embed(d.select(F.col("doc_id").alias("row_id"), "text", F.struct("source", F.length("text").alias("n")).alias("meta")), "text", models.hashing_embedder()), path)
    return readers.open_index(spark, path).select("row_id", F.md5("text").alias("text_md5"), "meta.source", "meta.n")


@query("SELECT query_id, bool_or(coalesce(node_hit, FALSE)) AS any_node, bool_or(coalesce(pair_hit, FALSE)) AS any_pair FROM kge_scores WHERE query_id IS NOT NULL GROUP BY query_id")
def io_cached_scores(t):
    """Scores computed once; a second run finds them and must not compute them again."""
    k, spark = t("kge_scores").where("query_id IS NOT NULL"), t("kge_scores").sparkSession
    path = _folder(spark)
    readers.cached_scores(spark, path, lambda: k.select("query_id", "node_hit", "pair_hit"))
    return readers.hit_sets(readers.cached_scores(spark, path, lambda: k.limit(0)))


@query("SELECT query_id, gold_label FROM student_claims_flat WHERE trim(coalesce(claim_text, '')) <> '' AND trim(coalesce(query_id, '')) <> '' AND gold_label IN ('entailed', 'neutral', 'contradicted')")
def io_labelled(t):
    """Labelled rows with all members filled and a label of the domain."""
    s, spark = t("student_claims_flat"), t("student_claims_flat").sparkSession
    path = _folder(spark)
    writers.jsonl(s.select("query_id", "claim_text", "gold_label"), path)
    return readers.labelled(readers.jsonl_strict(spark, path, "query_id string, claim_text string, gold_label string"), ["claim_text", "query_id"], "gold_label", ("entailed", "neutral", "contradicted")).select("query_id", "gold_label")


@query("SELECT 'rows' AS part, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'summary', 'all', count(*) FROM customer")
def io_rows_and_summary(t):
    """Rows and their summary, each with its own schema; runs partitioned by key."""
    c, spark = t("customer"), t("customer").sparkSession
    path = _folder(spark)
    writers.rows_and_summary(c.select("c_custkey", "c_mktsegment"), c.agg(F.count("*").alias("n")), path)
    writers.by_run(spark.read.json(f"{path}/rows"), f"{path}/runs", "c_mktsegment")
    rows = spark.read.parquet(f"{path}/runs").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")).select(F.lit("rows").alias("part"), "segment", "n")
    return rows.unionByName(spark.read.json(f"{path}/summary").select(F.lit("summary").alias("part"), F.lit("all").alias("segment"), "n"))


@query("""WITH x AS (SELECT CAST(row_number() OVER (ORDER BY n_regionkey, n_name) + 7 AS BIGINT) AS line_no, n_name || ' & ' || CAST(n_regionkey AS VARCHAR) || ' & ' || CASE WHEN n_regionkey = 2 THEN '--' ELSE printf('%.1f', n_nationkey / 4.0) END || ' \\\\' AS line FROM nation)
SELECT * FROM x""")
def io_latex(t):
    """The body of a report table: rows in order, one digit, nulls as dashes."""
    n, spark = t("nation"), t("nation").sparkSession
    d = n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.when(F.col("n_regionkey") != 2, F.col("n_nationkey") / 4.0).alias("share"))
    lines = writers.report(d, {"Name": "name", "Region": "region", "Share": "share"}, 1, "Nations.", "tab:nations", "region", "name").splitlines()
    body = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string")
    return body.where("line LIKE '% & %' AND line NOT LIKE 'Name%'")


_OUT = ["/r/a__kgfused.json", "/r/a__kgfused__kgfused.json", "/r/a.json", "/r/b.json", "/s/b__kgfused__kgfused__kgfused.json"]


@query("""SELECT * FROM (VALUES ('/r/a.json', 'keep', '/r/a.json'), ('/r/b.json', 'keep', '/r/b.json'), ('/r/a__kgfused.json', 'keep', '/r/a__kgfused.json'), ('/r/a__kgfused__kgfused.json', 'delete', '/r/a__kgfused.json'), ('/s/b__kgfused__kgfused__kgfused.json', 'rename', '/s/b__kgfused.json')) v(file, action, target)""")
def io_hygiene(t):
    """What a clean-up of repeated output tags would do to each file; nothing is done in a dry run."""
    return paths.cleanup(t("region").sparkSession.createDataFrame([(f,) for f in _OUT], "file string"))


@query("SELECT document_url AS url, CASE WHEN document_url IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN TRUE ELSE lower(document_url) LIKE '%.pdf' END AS is_pdf, doc_id FROM documents")
def io_pdf_sniff(t):
    """Documents that are PDFs by their address or, where it is known, by their content type."""
    d = t("documents").select("doc_id", F.col("document_url").alias("url"), F.when(F.col("doc_id") % 3 == 0, "application/PDF; charset=x").otherwise(F.when(F.col("doc_id") % 3 == 1, "text/html")).alias("kind"))
    return d.select("url", corpus.is_pdf(F.col("url"), F.col("kind")).alias("is_pdf"), "doc_id")


@query("SELECT question_focus AS item, least(5, count(DISTINCT document_url)) AS n_fetched, (SELECT count(*) FROM (SELECT DISTINCT question_focus, document_url FROM documents d2 WHERE d2.question_focus = d.question_focus AND d2.document_url <> '' ORDER BY 2 LIMIT 5)) AS n_pages FROM documents d WHERE document_url <> '' AND question_focus IS NOT NULL GROUP BY question_focus")
def io_fetch_capped(t):
    """At most five distinct addresses an item are fetched, in order; the client here gives each address its own text."""
    d = t("documents").where("document_url <> '' AND question_focus IS NOT NULL").select(F.col("question_focus").alias("item"), F.col("document_url").alias("url"))
    f = corpus.fetch_items(d, "item", "url", lambda: lambda u: "page of " + u, 5)
    return f.groupBy("item").agg(F.count("*").alias("n_fetched"), F.count("page").alias("n_pages"))
