"""Claims, evidence and their alignment; rows for training extractors and checkers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions import text
from claimlake.functions.text import norm

# Member names under which evidence texts, ids and titles are found, in order of preference.
TEXT_KEYS = ("text", "content", "passage", "chunk", "body", "abstract", "snippet", "document")
ID_KEYS = ("doc_id", "pmid", "id", "uuid", "hash")
NAME_KEYS = ("title", "name", "doc_name", "filename")

# The prompts.
EXTRACT_PROMPT = (
    "You are an information extraction assistant. Extract factual triples from the given answer.\nReturn a pure JSON array of triples as [[subject, relation, object], ...].\nDo not include explanations.\n\nQuestion:\n%s\n\nAnswer:\n%s\n"
)
CHECK_PROMPT = "Decide whether the EVIDENCE entails, contradicts, or is neutral to the CLAIM.\nRespond with one of: entailed | contradicted | neutral\n\nCLAIM:\n%s\n\nEVIDENCE:\n%s\n\nLabel:"
PAIR_PROMPT = "Task: Determine the relation between a claim and the evidence.\nPairType: %s\n\nClaim:\n%s\n\nEvidence:\n%s\n"


def _member(v: Column, path: str) -> Column:
    return F.nullif(norm(F.try_variant_get(v, path, "string")), F.lit(""))


def evidence_text(v: Column) -> Column:
    """Text of a context record (VARIANT): its own text members, else those and titles under metadata or meta,
    else all its strings of 20 to 2000 characters; empty if there is nothing."""
    own = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", _member(v, f"$.{k}")) for k in TEXT_KEYS]
    nested = [_member(v, f"$.{m}.{k}") for m in ("metadata", "meta") for k in (*TEXT_KEYS, *NAME_KEYS)]
    strings = F.map_values(F.coalesce(v.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>")))
    plain = F.transform(F.filter(strings, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    medium = F.filter(plain, lambda x: (F.length(x) >= 20) & (F.length(x) <= 2000))
    return F.coalesce(*own, *nested, norm(F.array_join(medium, " ")), F.lit(""))


def match_key(v: Column) -> Column:
    """Key of a context record to match label tables: its first string id or title."""
    return F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get(v, f"$.{k}", "string")), F.lit(""))) for k in (*ID_KEYS, *NAME_KEYS)))


def coerce(v: Column) -> Column:
    """Claims of any shape (VARIANT array) as sentences: triples as "s r o.", strings as they are."""
    items = F.coalesce(v.try_cast("array<variant>"), F.array().cast("array<variant>"))

    def one(x: Column) -> Column:
        parts = F.transform(x.try_cast("array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$", "string"), F.lit("None")))
        triple = F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2], F.lit("."))
        return F.when(F.size(parts) == 3, triple).otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("None")))

    return F.transform(items, one)


def triples(v: Column) -> Column:
    """ARRAY<ARRAY<STRING>> of the valid triples: three members, none blank; nulls become None."""
    items = F.coalesce(v.try_cast("array<variant>"), F.array().cast("array<variant>"))
    parts = F.transform(items, lambda x: F.transform(x.try_cast("array<variant>"), lambda p: norm(F.coalesce(F.try_variant_get(p, "$", "string"), F.lit("None")))))
    return F.filter(parts, lambda x: (F.size(x) == 3) & F.forall(x, lambda p: p != ""))


def shaped(record: Column) -> Column:
    """Claim texts of a record (VARIANT): response_claims if present, even if empty, else three other names."""
    def texts(path: str) -> Column:
        items = F.try_variant_get(record, path, "array<variant>")
        return F.filter(F.transform(items, lambda x: F.trim(F.coalesce(F.array_join(x.try_cast("array<string>"), " "), F.try_variant_get(x, "$", "string")))), lambda x: x.isNotNull())

    none = F.array().cast("array<string>")
    present = F.map_contains_key(F.coalesce(record.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>")), "response_claims")
    return F.when(present, F.coalesce(texts("$.response_claims"), none)).otherwise(F.coalesce(texts("$.claims"), texts("$.atomic_claims"), texts("$.extracted_claims"), none))


def distinct_claims(claims: Column) -> Column:
    """Normalised claims in order, the first spelling of each kept; blank ones dropped."""
    n = F.filter(F.transform(claims, norm), lambda x: x != "")
    keys = F.transform(n, F.lower)
    return F.transform(F.filter(F.transform(n, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(keys, F.lower(s["x"])) == s["i"] + 1), lambda s: s["x"])


def align(keys: Column, labels: Column) -> Column:
    """Labels (MAP) for a list of document keys: exact key first, else any letter case; null if none matches.

    Of documents with the same key only the last gets the label, as in a dictionary of keys.
    """
    pairs = F.map_entries(labels)
    last = lambda k, i: ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda z: z.eqNullSafe(k))

    def one(k: Column, i: Column) -> Column:
        exact = F.try_element_at(labels, k)
        loose = F.try_element_at(F.filter(pairs, lambda e: F.lower(e["key"]) == F.lower(k)), F.lit(1))["value"]
        return F.when(k.isNotNull() & last(k, i), F.coalesce(exact, loose))

    return F.transform(keys, one)


def checker_pairs(rows: DataFrame, key: str, claims: str, evidence: str, labels: str, least_chars: int = 40, least_overlap: float = 0.0, compat: bool = False) -> DataFrame:
    """(key, claim_no, doc_no, prompt, label): one row a labelled claim and evidence pair.

    ``labels`` is ARRAY<ARRAY<STRING>> by original claim and document position.  Claims are deduplicated and
    short evidence dropped without moving positions; with ``compat`` positions count what is left, as
    pipelines that filter before they align have it.
    """
    known = F.coalesce(*(F.when(F.col("raw_label") == k, v) for k, v in text.LABEL_CANON.items()), *(F.when(F.initcap(F.lower(F.col("raw_label"))) == k, v) for k, v in text.LABEL_CANON.items()))
    c = rows.withColumn("_k", F.transform(F.transform(claims, norm), F.lower))
    if compat:
        c = c.withColumn("_c", distinct_claims(F.col(claims))).withColumn("_e", F.filter(F.transform(evidence, norm), lambda x: F.length(x) >= least_chars))
        c = c.select(key, "_k", "_e", labels, F.posexplode("_c").alias("claim_no", "claim"))
    else:
        c = c.withColumn("_e", F.transform(evidence, norm)).select(key, "_k", "_e", labels, F.posexplode(F.transform(claims, norm)).alias("claim_no", "claim"))
        c = c.where((F.col("claim") != "") & (F.array_position("_k", F.lower("claim")) == F.col("claim_no") + 1))
    p = c.select(key, "claim_no", "claim", labels, F.posexplode("_e").alias("doc_no", "ev")).where(F.length("ev") >= least_chars)
    p = p.withColumn("raw_label", F.try_element_at(F.try_element_at(labels, F.col("claim_no") + 1), F.col("doc_no") + 1)).withColumn("label", known).where("label IS NOT NULL")
    if least_overlap > 0:
        p = p.where(text.jaccard(F.array_distinct(text.kg_tokens("claim")), F.array_distinct(text.kg_tokens("ev"))) >= least_overlap)
    return p.select(key, "claim_no", "doc_no", F.format_string(CHECK_PROMPT, "claim", "ev").alias("prompt"), "label")


def pair_text(kind: Column, claim: Column, evidence: Column) -> Column:
    """Input of an encoder that judges a claim against evidence."""
    return F.format_string(PAIR_PROMPT, kind, claim, evidence)


def json_rows(t: Column) -> Column:
    """JSON text of ARRAY<ARRAY<STRING>> with a space after each comma and non-ASCII kept."""
    quote = lambda s: F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2)
    row = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, quote), ", "), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(t, row), ", "), F.lit("]"))


def extractor_rows(rows: DataFrame, query: str, response: str, gold: str, gold_triples: str, response_triples: str, least: int = 10) -> DataFrame:
    """(instruction, output): gold triples as the target, else the response's; rows without either or without
    any text are dropped; a short response gives way to the gold answer."""
    target = F.when(F.size(gold_triples) > 0, F.col(gold_triples)).when(F.size(response_triples) > 0, F.col(response_triples))
    r, q = F.coalesce(response, F.lit("")), F.coalesce(query, F.lit(""))
    answer = F.when(F.length(text.strip(r)) >= least, r).otherwise(F.coalesce(gold, F.lit("")))
    d = rows.withColumns({"_t": target, "_a": answer, "_q": q}).where(F.col("_t").isNotNull() & ((F.length(text.strip("_a")) >= least) | (F.length(text.strip("_q")) >= 1)))
    return d.withColumn("instruction", F.format_string(EXTRACT_PROMPT, "_q", "_a")).withColumn("output", json_rows(F.col("_t"))).drop("_t", "_a", "_q")


def infer_inputs(rows: DataFrame, key: str, query: str, response: str, gold: str, least: int = 10) -> DataFrame:
    """(query_id, question, answer) of rows with an answer of enough characters or any question."""
    r = F.coalesce(response, F.lit(""))
    a = F.when(F.length(text.strip(r)) >= least, r).otherwise(F.coalesce(gold, F.lit("")))
    q = F.coalesce(query, F.lit(""))
    keep = (F.length(text.strip(a)) >= least) | (F.length(text.strip(q)) >= 1)
    return rows.where(keep).select(F.col(key).alias("query_id"), norm(q).alias("question"), norm(a).alias("answer"))
