"""Heterogeneous question-answer records into one shape.

Raw records come as VARIANT columns.  Output: dataset, id, question, contexts ARRAY<STRING>, answer, label,
metadata VARIANT.  As in loosely typed sources, empty strings count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.text import first_filled, strip


def get(v: str, key: str) -> Column:
    """A member of a variant as a string; null if absent or of another shape."""
    return F.try_variant_get(F.col(v), f"$.{key}", "string")


def _contexts(v: str, path: str) -> Column:
    """Contexts of any shape: list of strings, object with ``contexts``, JSON in a string, scalar, null."""
    one = lambda c: F.coalesce(
        F.try_variant_get(c, "$", "array<string>"), F.try_variant_get(c, "$.contexts", "array<string>"),
        F.when(F.try_variant_get(c, "$.contexts", "string").isNotNull(), F.array(F.try_variant_get(c, "$.contexts", "string"))),
    )
    c = F.try_variant_get(F.col(v), path, "variant")
    text = F.try_variant_get(F.col(v), path, "string")
    inner = one(F.try_parse_json(text))
    return F.coalesce(one(c), inner, F.when(text.isNotNull(), F.array(text)), F.array().cast("array<string>"))


def _row(dataset: str, i: Column, q: Column, contexts: Column, answer: Column, label: Column, meta: Column) -> list[Column]:
    return [F.lit(dataset).alias("dataset"), i.alias("id"), q.alias("question"), contexts.alias("contexts"), answer.alias("answer"), label.alias("label"), F.parse_json(meta).alias("metadata")]


def abstracts(raw: DataFrame, v: str, subset: str) -> DataFrame:
    """Abstract-based yes/no/maybe questions."""
    label = F.nullif(first_filled(get(v, "final_decision"), get(v, "label")), F.lit(""))
    return raw.select(
        *_row(
            "qiaojin/PubMedQA", first_filled(get(v, "pubid"), get(v, "id"), get(v, "pub_id")), first_filled(get(v, "question"), get(v, "QUESTION")), _contexts(v, "$.context"),
            first_filled(get(v, "long_answer"), get(v, "answer")), label, F.to_json(F.struct(F.lit(subset).alias("subset"))),
        )
    )


def pages(raw: DataFrame, v: str) -> DataFrame:
    """Questions answered from web pages; eight descriptive keys go to the metadata, no contexts."""
    keys = ("umls_cui", "umls_semantic_group", "umls_semantic_types", "question_focus", "question_type", "category", "synonyms")
    meta = F.struct(*(get(v, k).alias(k) for k in keys), F.nullif(first_filled(get(v, "source"), get(v, "link")), F.lit("")).alias("source"))
    return raw.select(*_row("lavita/MedQuAD", first_filled(get(v, "question_id"), get(v, "id")), first_filled(get(v, "question")), F.array().cast("array<string>"), first_filled(get(v, "answer")), F.lit(None).cast("string"), F.to_json(meta)))


def live(raw: DataFrame, v: str, join_all: bool = False) -> DataFrame:
    """Consumer questions: the paraphrase, else subject and message, else the id; first or all reference answers."""
    subject, message = strip(first_filled(get(v, "ORIGINAL_QUESTION_SUBJECT"))), strip(first_filled(get(v, "ORIGINAL_QUESTION_MESSAGE")))
    joined = F.array_join(F.filter(F.array(subject, message), lambda x: x != ""), " ")
    q = first_filled(strip(get(v, "NIST_PARAPHRASE")), joined, get(v, "QUESTION_ID"))
    refs = F.coalesce(F.try_variant_get(F.col(v), "$.REFERENCE_ANSWERS", "array<variant>"), F.array().cast("array<variant>"))
    member = lambda k: F.filter(F.transform(refs, lambda r: F.coalesce(F.try_variant_get(r, f"$.{k}", "string"), F.try_variant_get(r, "$", "string") if k == "ANSWER" else F.lit(None).cast("string"))), lambda x: x.isNotNull() & (x != ""))
    answers, urls = member("ANSWER"), member("AnswerURL")
    answer = F.array_join(answers, "\n\n") if join_all else F.coalesce(F.try_element_at(answers, F.lit(1)), F.lit(""))
    ctx = F.array(F.nullif(get(v, "NLM_SUMMARY"), F.lit("")), F.concat(F.lit("[SUBJECT] "), F.nullif(get(v, "ORIGINAL_QUESTION_SUBJECT"), F.lit(""))), F.concat(F.lit("[MESSAGE] "), F.nullif(get(v, "ORIGINAL_QUESTION_MESSAGE"), F.lit(""))))
    notes = F.struct(get(v, "ANNOTATIONS_FOCUS").alias("focus"), get(v, "ANNOTATIONS_TYPE").alias("type"), get(v, "ANNOTATIONS_KEYWORD").alias("keyword"))
    meta = F.struct(urls.alias("urls"), get(v, "ORIGINAL_QUESTION_FILE").alias("file"), notes.alias("annotations"))
    return raw.select(*_row("hyesunyun/liveqa_medical_trec2017", first_filled(get(v, "QUESTION_ID"), get(v, "id")), q, F.array_compact(ctx), answer, F.lit(None).cast("string"), F.to_json(meta)))


def local(raw: DataFrame, v: str, position: str, split: str) -> DataFrame:
    """Local split files: the document is the one context, the position in the file the id."""
    text = lambda k: strip(F.coalesce(get(v, k), F.lit("")))
    doc = text("document")
    ctx = F.when(doc != "", F.array(doc)).otherwise(F.array().cast("array<string>"))
    meta = F.struct(F.lit("CSIRO-MedRedQA+PubMed").alias("source"), F.lit(split).alias("split"))
    return raw.select(*_row("csiro/medredqa_pubmed", F.col(position).cast("string"), text("question"), ctx, text("response"), F.lit(None).cast("string"), F.to_json(meta)))


def gold_hits(contexts: Column) -> Column:
    """Gold contexts as a hit list with ids csiro-gold-1, csiro-gold-2 and so on."""
    hit = lambda c, i: F.struct(F.concat(F.lit("csiro-gold-"), (i + 1).cast("string")).alias("doc_id"), c.alias("text"), F.lit("").alias("title"), F.lit(1.0).alias("score"), F.lit("csiro_gold").alias("source"))
    return F.transform(contexts, hit)
