"""Queries on text: normal forms, tokens, labels, aliases, deduplication, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlake.functions import text
from claimlake.operators import corpus, ranking
from claimlake.plans.registry import query

SP = text.SPACE
NORM = lambda c: f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"
STRIP = lambda c: f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


@query(f"SELECT doc_id, md5({NORM('text')}) AS text_md5, substr(sha1(text), 1, 16) AS short_hash FROM documents")
def ws_normalize_docs(t):
    return t("documents").select("doc_id", F.md5(text.norm("text")).alias("text_md5"), text.short_hash("text").alias("short_hash"))


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{text.KG_TOKEN}')) AS token FROM documents) GROUP BY token")
def kg_token_counts(t):
    # each row says which of its tokens are its first of a kind, so one shuffle of partial counts gives both numbers
    d = t("documents").select(F.array_sort(text.kg_tokens("text")).alias("_t")).where("size(_t) > 0")
    d = d.select(F.inline(F.arrays_zip(F.col("_t").alias("token"), F.concat(F.array(F.lit("")), F.slice("_t", 1, F.size("_t") - 1)).alias("before"))))
    return d.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("token") != F.col("before")).alias("n_docs"))


_BRACKETS = r"\([^\n]*?\)|\[[^\n]*?\]"
_DOSAGE = r"\b(?:" + "|".join(text.DOSAGE_WORDS) + r")\b"
_BIO = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({STRIP('lower(name)')}, '{_BRACKETS}', ' ', 'g'), '{_DOSAGE}', ' ', 'g'), '[^a-z0-9+/\\s-]', ' ', 'g'), '{SP}+', ' ', 'g'))"


@query(f"SELECT biomed, count(*) AS n FROM (SELECT {_BIO} AS biomed FROM name_map) GROUP BY biomed")
def biomed_text_norm(t):
    return t("name_map").groupBy(text.biomed("name").alias("biomed")).agg(F.count("*").alias("n"))


@query(f"SELECT surface, count(*) AS n FROM (SELECT {NORM('lower(name)')} AS surface FROM name_map) GROUP BY surface")
def surface_norm(t):
    return t("name_map").groupBy(text.surface("name").alias("surface")).agg(F.count("*").alias("n"))


_PARA = STRIP("regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, md5({_PARA}) AS clean_md5, length({_PARA}) >= 300 AS long_enough FROM documents")
def paragraph_clean(t):
    clean = text.paragraphs("text")
    return t("documents").select("doc_id", F.md5(clean).alias("clean_md5"), (F.length(clean) >= 300).alias("long_enough"))


_HTML = "'<html><head><style>p {x: y}</style></head><body><p>' || coalesce(text, '') || '</p><script>if (a < b) run()</script>&amp;&nbsp;end &#8211; &#x41;&#xD800;&rsquo; &#; &#12</body></html>'"
_HT = f"regexp_replace(regexp_replace({_HTML}, '(?is)<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _a, _b in (("&#8211;", "–"), ("&#x41;", "A"), ("&#xD800;", "�"), ("&rsquo;", "’"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _HT = f"replace({_HT}, '{_a}', '{_b}')"


@query(f"SELECT doc_id, md5({NORM(_HT)}) AS visible_md5 FROM documents")
def html_to_text(t):
    page = F.concat(F.lit("<html><head><style>p {x: y}</style></head><body><p>"), F.coalesce("text", F.lit("")), F.lit("</p><script>if (a < b) run()</script>&amp;&nbsp;end &#8211; &#x41;&#xD800;&rsquo; &#; &#12</body></html>"))
    return t("documents").select("doc_id", F.md5(text.html_text(page)).alias("visible_md5"))


@query()
def chunk_documents(t):
    return corpus.chunks(t("documents"), "doc_id", "text").select("doc_id", "chunk_index", "num_chunks", F.md5("chunk").alias("chunk_md5"))


@query("""WITH d AS (SELECT doc_id, length(text) // 10 + 1 AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, n, CASE WHEN n <= 100 THEN 1 ELSE 1 + (n - 100 + 84) // 85 END AS k FROM d), x AS (SELECT *, unnest(range(0, k)) AS j FROM c)
SELECT doc_id, CAST(j AS INTEGER) AS chunk_index, CAST(k AS INTEGER) AS num_chunks, md5(list_reduce(list_transform(range(85 * j + 1, least(n, 85 * j + 100) + 1), lambda i: lpad(CAST(i AS VARCHAR), 9, '0')), lambda a, b: a || ' ' || b)) AS chunk_md5 FROM x""")
def chunk_ordinals(t):
    """The chunker on texts of nine-letter words, as many as each document has tens of characters, whose chunks have a closed
    form: 100 words, 15 of them overlapping."""
    words = F.transform(F.sequence(F.lit(1), F.floor(F.length("text") / 10).cast("int") + 1), lambda i: F.lpad(i.cast("string"), 9, "0"))
    d = t("documents").where("text IS NOT NULL").select("doc_id", F.array_join(words, " ").alias("text"))
    return corpus.chunks(d, "doc_id", "text").select("doc_id", "chunk_index", "num_chunks", F.md5("chunk").alias("chunk_md5"))


_UID = "CASE WHEN trim(coalesce(document_id, '')) <> '' THEN 'document_id:' || trim(document_id) ELSE 'md5:' || md5(trim(coalesce(question_focus, '')) || chr(10) || trim(coalesce(text, ''))) END"


@query(f"SELECT uid, min(doc_id) AS doc_id, count(*) AS n_rows FROM (SELECT doc_id, {_UID} AS uid FROM documents) GROUP BY uid")
def doc_dedup_hash(t):
    uid = corpus.row_uid("document_id", "question_focus", "text")
    return t("documents").groupBy(uid.alias("uid")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"))


@query("SELECT document_id, document_url, min(doc_id) AS doc_id FROM documents WHERE length(text) >= 300 AND document_url IS NOT NULL AND document_url <> '' GROUP BY document_id, document_url")
def url_dedup(t):
    d = t("documents").where((F.length("text") >= 300) & (F.col("document_url") != "")).select("document_id", "document_url", "doc_id")
    return ranking.keep_first(d, ["document_id", "document_url"], F.col("doc_id"))


@query(f"SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE text IS NULL) AS n_null, count(*) FILTER (WHERE length({STRIP('text')}) < 10) AS n_short, count(*) FILTER (WHERE length({STRIP('text')}) >= 40) AS n_evidence FROM documents GROUP BY source")
def drop_counts(t):
    n = F.length(text.strip("text"))
    return t("documents").groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("text").isNull()).alias("n_null"), F.count_if(n < 10).alias("n_short"), F.count_if(n >= 40).alias("n_evidence"))


@query("SELECT origin, dataset, count(*) AS n FROM (SELECT 'qa_items' AS origin, dataset FROM qa_items UNION ALL SELECT 'qa_split_items', dataset FROM qa_split_items) GROUP BY origin, dataset")
def union_splits(t):
    u = t("qa_items").select(F.lit("qa_items").alias("origin"), "dataset").unionByName(t("qa_split_items").select(F.lit("qa_split_items").alias("origin"), "dataset"))
    return u.groupBy("origin", "dataset").agg(F.count("*").alias("n"))


@query("SELECT query_id FROM rag_rows WHERE query_id IS NOT NULL INTERSECT SELECT id FROM qa_items")
def key_intersect(t):
    return t("rag_rows").select("query_id").where("query_id IS NOT NULL").intersect(t("qa_items").select(F.col("id").alias("query_id")))


@query("SELECT id FROM (SELECT DISTINCT id FROM qa_items WHERE id IS NOT NULL) WHERE id NOT IN (SELECT query_id FROM kge_scores WHERE query_id IS NOT NULL)")
def keys_without_scores(t):
    return t("qa_items").select("id").where("id IS NOT NULL").distinct().join(t("kge_scores").select(F.col("query_id").alias("id")), "id", "left_anti")


@query("SELECT event_id, CAST(printf('%.1f', value / 8) AS DOUBLE) AS one, CAST(printf('%.3f', value / 16) AS DOUBLE) AS three FROM (SELECT event_id, round(value) AS value FROM events)")
def number_format(t):
    """Rounding by the binary value, ties to even, as reports have it."""
    from claimlake.functions import scores

    v = F.round("value")
    return t("events").select("event_id", scores.round_binary(v / 8, 1).alias("one"), scores.round_binary(v / 16, 3).alias("three"))


@query("SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM documents ORDER BY shuffle_key")
def hash_shuffle(t):
    return t("documents").select("doc_id", F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))).alias("shuffle_key")).orderBy("shuffle_key")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def first_n_eval(t):
    """The first-N evaluation cap is the feature here."""
    return t("documents").select("doc_id", "source").orderBy("doc_id").limit(100)


@query("SELECT cap, count(*) AS n FROM (SELECT 'unlimited' AS cap FROM qa_items UNION ALL SELECT 'default' FROM (SELECT 1 FROM qa_items LIMIT 50) UNION ALL SELECT 'zero' FROM (SELECT 1 FROM qa_items LIMIT 1)) GROUP BY cap")
def source_limits(t):
    """Row caps of a source: negative means all, none given means 50, zero still gives one row."""
    q = t("qa_items").select("id")
    parts = [corpus.capped(q, n).select(F.lit(name).alias("cap")) for name, n in (("unlimited", -1), ("default", None), ("zero", 0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("cap").agg(F.count("*").alias("n"))


_T = f"trim(replace(replace(lower({STRIP('label')}), '.', ''), 'label:', ''))"
_FREE = "CASE " + " ".join(f"WHEN regexp_matches(x, '^(?:{'|'.join(a)})') THEN '{k}'" for k, a in text.LABEL_ALIASES.items())
_FREE += " WHEN contains(x, 'contrad') OR contains(x, 'refut') THEN 'contradicted' WHEN contains(x, 'neutral') OR contains(x, 'insufficient') OR contains(x, 'not enough') OR contains(x, 'uncertain') THEN 'neutral' WHEN contains(x, 'entail') OR contains(x, 'support') OR x = 'y' THEN 'entailed' END"
_STRICT = f"CASE lower({STRIP('label')}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.STRICT_LABELS.items()) + " END"
_EXACT = "CASE lower(label) WHEN 'entailment' THEN 'entailed' WHEN 'contradiction' THEN 'contradicted' WHEN 'neutral' THEN 'neutral' END"


@query(f"SELECT label, count(*) AS n, any_value(free) AS free, any_value(strict) AS strict, any_value(exact) AS exact FROM (SELECT label, {_FREE} AS free, {_STRICT} AS strict, {_EXACT} AS exact FROM (SELECT label, {_T} AS x FROM (SELECT gold_label AS label FROM student_claims_flat UNION ALL SELECT teacher_label FROM student_claims_flat))) GROUP BY label")
def label_normalize(t):
    s = t("student_claims_flat")
    u = s.select(F.col("gold_label").alias("label")).unionByName(s.select(F.col("teacher_label").alias("label")))
    n = u.groupBy("label").agg(F.count("*").alias("n"))
    return n.select("label", "n", text.label_free("label").alias("free"), text.label_strict("label").alias("strict"), text.label_exact("label").alias("exact"))


_ALIAS = """
WITH e AS (SELECT idx, trim(raw_id) AS r FROM entities WHERE raw_id IS NOT NULL),
f AS (SELECT idx, [r, CASE WHEN contains(r, '::') THEN string_split(r, '::')[-1] END, CASE WHEN contains(r, ':') THEN string_split(r, ':')[-1] END, CASE WHEN contains(r, '/') THEN string_split(r, '/')[-1] END, CASE WHEN contains(r, '|') THEN string_split(r, '|')[-1] END, replace(r, '_', ' '), replace(r, '-', ' ')] AS forms FROM e),
s AS (SELECT DISTINCT idx, surface FROM (SELECT idx, trim(regexp_replace(lower(unnest(forms)), '\\s+', ' ', 'g')) AS surface FROM f) WHERE length(surface) >= 3)
"""


@query(_ALIAS + "SELECT surface, min(idx) AS eid, count(*) AS n_entities FROM s GROUP BY surface")
def alias_surfaces(t):
    e = t("entities").where("raw_id IS NOT NULL").select("idx", F.explode(text.aliases("raw_id")).alias("surface"))
    return e.groupBy("surface").agg(F.min("idx").alias("eid"), F.count("*").alias("n_entities"))


@query("SELECT CAST(event_id AS BIGINT) AS event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) > 50 AS high FROM events")
def json_props(t):
    from claimlake.functions import scores

    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'string')")
    return t("events").select("event_id", scores.safe_double(k, None).alias("k"), (scores.safe_double(k) > 50).alias("high"))
