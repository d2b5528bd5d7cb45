"""Drivers composed of operators: distillation sets, fusion of result files, corpus build, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions import models, scores, text
from claimlake.operators import claims, context, corpus, fusion, kgscore, linking, metrics, paths, ranking, retrieval
from claimlake.runtime import cut_lineage
from claimlake.sources import readers


def evaluated(docs: DataFrame) -> DataFrame:
    """Typed rows of evaluated result documents: query_id, query, response, gt_answer, claims, evidence, labels, metrics."""
    r = readers.results(docs)
    g = lambda k: F.try_variant_get("record", f"$.{k}", "string")
    v = lambda k: F.try_variant_get("record", f"$.{k}", "variant")
    own, gold = claims.coerce(v("response_claims")), claims.coerce(v("gt_answer_claims"))
    ctx = F.coalesce(F.try_variant_get("record", "$.retrieved_context", "array<variant>"), F.array().cast("array<variant>"))
    return r.select(
        "file", "pos", F.coalesce(g("query_id"), g("id")).alias("query_id"), F.coalesce(g("query"), g("question")).alias("query"), F.coalesce(g("response"), g("answer")).alias("response"), g("gt_answer").alias("gt_answer"),
        F.when(F.size(own) > 0, own).otherwise(gold).alias("claims"), claims.shaped(F.col("record")).alias("claim_texts"), claims.triples(v("gt_answer_claims")).alias("gold_triples"), claims.triples(v("response_claims")).alias("response_triples"), gold.alias("gold_claims"),
        F.transform(ctx, claims.evidence_text).alias("evidence"), F.transform(ctx, claims.match_key).alias("evidence_keys"),
        F.try_variant_get("record", "$.retrieved2response", "array<variant>").alias("label_rows"),
        F.try_variant_get("record", "$.metrics.hallucination", "double").alias("hallucination"), F.try_variant_get("record", "$.metrics.faithfulness", "double").alias("faithfulness"),
    )


def distinct_rows(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows of several files, the first of each identity by path and position."""
    uid = corpus.row_uid(key, "query", "response") if key != "none" else F.concat_ws("#", "file", "pos")
    return ranking.keep_first(rows.withColumn("_uid", uid), ["_uid"], F.col("file"), F.col("pos")).drop("_uid")


def distillation(docs: DataFrame, key: str = "query_id", rebalance: str = "none", compat: bool = False) -> dict[str, DataFrame]:
    """Training sets from evaluated documents: extractor rows, checker pairs, inputs, claims of both sides, drop counts."""
    rows = distinct_rows(evaluated(docs), key)
    # each claim's labels are a list by document position, or a table by document key
    labels = F.transform("label_rows", lambda x: F.coalesce(x.try_cast("array<string>"), claims.align(F.col("evidence_keys"), x.try_cast("map<string,string>"))))
    pairs = claims.checker_pairs(rows.withColumn("labels", labels), "query_id", "claims", "evidence", "labels", compat=compat)
    if rebalance != "none":
        pairs = ranking.rebalance(pairs, "label", F.concat_ws("#", "query_id", "claim_no", "doc_no"), {"downsample": "down", "upsample": "up"}[rebalance], text.LABELS)
    extractor = claims.extractor_rows(rows, "query", "response", "gt_answer", "gold_triples", "response_triples")
    listed = lambda c: rows.select("query_id", claims.distinct_claims(F.col(c)).alias("pred_claims")).where(F.size("pred_claims") > 0)
    counts = rows.agg(F.count("*").alias("n_rows"), F.count_if((F.size("gold_triples") == 0) & (F.size("response_triples") == 0)).alias("n_without_triples"))
    return {
        "extractor": extractor.select("instruction", "output"), "checker": pairs.select("prompt", "label"), "infer_inputs": claims.infer_inputs(rows, "query_id", "query", "response", "gt_answer"),
        "teacher_claims": listed("claims"), "gt_claims": listed("gold_claims"), "file_counts": rows.groupBy("file").agg(F.count("*").alias("n_rows")), "counts": counts,
    }


def fuse_file(students: DataFrame, scored: DataFrame, beta: float = 0.8, agg: str = "max", k: int = 10, hit_only: bool = False, calibration: str = "none") -> DataFrame:
    """Claims of student files (file, query_id, claim_idx, nli) fused with score rows (query_id, p_final, node_hit, pair_hit)."""
    index = kgscore.index(scored, agg=agg, k=k, hit_only=hit_only)
    if calibration != "none":
        index = kgscore.calibrated(index, "score", calibration).drop("score").withColumnRenamed("calibrated", "score")
    return fusion.fuse(fusion.attach(fusion.probabilities(students), index), beta)


def summarise(fused: DataFrame, file: str = "file") -> DataFrame:
    """The fusion summary of each file with model and method from its name."""
    named = paths.file_columns(F.col(file))
    return fusion.summary(fused, file).select("*", *named[:2])


def score_questions(rows: DataFrame, surfaces: DataFrame, vectors: DataFrame, eid: str, vec: str, most: int = 80) -> tuple[DataFrame, DataFrame]:
    """(questions, pairs): relation-free graph scores of each question from the entities in its claims.

    questions (query_id, n_entities, node_hit, pair_hit) has every question, with or without scored pairs.
    """
    each = rows.select("query_id", F.explode("claim_texts").alias("claim"))
    found = linking.mentions(each, "query_id", "claim", surfaces)
    ids = found.groupBy("query_id").agg(F.array_sort(F.collect_set("eid")).alias("ids"))  # entities of one question
    pairs = kgscore.pair_scores(ids, "query_id", "ids", vectors, eid, vec, most)
    hit = pairs.select("query_id").distinct().withColumn("pair_hit", F.lit(True))
    q = rows.select("query_id").distinct().join(ids, "query_id", "left").join(hit, "query_id", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    return q.select("query_id", F.greatest(n, F.lit(0)).alias("n_entities"), (n > 0).alias("node_hit"), F.coalesce("pair_hit", F.lit(False)).alias("pair_hit")), pairs


def run_summary(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """One row a run file: coverage and mean metrics, of all questions and of those with a pair hit, in percent; the
    largest run of each setting only."""
    index = questions.select("query_id", F.col("node_hit").cast("int").alias("n_node_hit"), F.col("pair_hit").cast("int").alias("n_pair_hit"))
    pct = rows.withColumns({"hallucination": F.col("hallucination") * 100, "faithfulness": F.col("faithfulness") * 100})
    s = metrics.graph_effect(pct, index, "query_id", ["file"]).select("*", *paths.run_columns(F.col("file")))
    return ranking.top_k(s, ["dataset", "generator", "teacher"], 1, F.desc("n_q"), F.asc("file")).drop("rank")


def build_corpus(pages: DataFrame, key: str, url: str, html: str, embedder=None, least: int = 300) -> DataFrame:
    """Chunk table of web pages: first row of each (key, url), visible text of enough characters, chunks, vectors."""
    first = ranking.keep_first(pages.where(F.coalesce(F.col(url), F.lit("")) != "").select(key, url, html), [key, url], F.col(html))
    clean = first.select(key, url, text.paragraphs(text.html_text(html)).alias("text")).where(F.length("text") >= least)
    c = corpus.chunks(clean, key, "text").select(key, url, "chunk_index", "num_chunks", F.concat_ws("#", F.col(key).cast("string"), "chunk_index").alias("chunk_id"), F.col("chunk").alias("text"))
    return models.embed(c, "text", embedder or models.hashing_embedder())


def fallback_label(answer: Column) -> Column:
    """Label of a checker's answer; what cannot be read is neutral."""
    return F.coalesce(text.label_free(answer), F.lit("neutral"))


def rag_inputs(items: DataFrame, legs: dict[str, DataFrame], docs: DataFrame, k: int = 8, weights: str = "", k_rrf: float = 60.0) -> DataFrame:
    """Rows for a generator: query_id, query, gt_answer, rag_response, retrieved_context, retrieved_images.

    ``items`` are unified rows, ``legs`` ranked hits (query_id, doc_id, score, rank) by name, fused by reciprocal
    rank; ``docs`` has doc_id, text, title, source.  Items without a hit keep an empty context.
    """
    w = retrieval.weights(weights)
    runs = None
    for i, (name, hits) in enumerate(legs.items()):
        one = hits.select("query_id", "doc_id", "score", "rank").withColumn("weight", F.lit(w.get(name, 1.0))).withColumn("run_no", F.lit(i))
        runs = one if runs is None else runs.unionByName(one)
    ctx = retrieval.hits_to_rows(retrieval.reciprocal_rank(runs, "query_id", "doc_id", k, k_rrf), "query_id", "doc_id", docs, "text", "title", "source")
    j = items.select(F.col("id").alias("query_id"), F.col("question").alias("query"), F.col("answer").alias("gt_answer")).join(ctx, "query_id", "left")
    kind = ctx.schema["retrieved_context"].dataType
    return j.select("query_id", "query", "gt_answer", F.lit("").alias("rag_response"), F.coalesce("retrieved_context", F.array().cast(kind)).alias("retrieved_context"), F.array().cast("array<string>").alias("retrieved_images"))


def generate_answers(rows: DataFrame, client, window: int = 4096, max_new: int = 128, margin: int = 256, max_docs: int = 8, max_chars: int = 1200) -> DataFrame:
    """``rows`` with rag_response from a generator; prompts over the budget are tried without context, else skipped with
    an empty answer and _skipped_overflow."""
    q = F.coalesce("query", F.lit(""))
    texts = F.transform("retrieved_context", lambda d: d["text"])
    d = rows.withColumn("_packed", context.pack(q, texts, window, max_new, margin, max_docs, max_chars)).withColumn("_prompt", context.answer_prompt(q, F.col("_packed")))
    d = d.withColumn("_skipped_overflow", context.overflow(window, max_new, margin, text.token_estimate(F.col("_prompt"))))
    asked = models.generate(d.where("NOT _skipped_overflow").drop("rag_response"), "_prompt", client, "rag_response", "")
    skipped = d.where("_skipped_overflow").withColumn("rag_response", F.lit(""))
    return asked.unionByName(skipped.select(*asked.columns)).drop("_packed", "_prompt")


def evaluate_checker(pairs: DataFrame, client, prompt: str = "prompt", label: str = "label") -> dict[str, DataFrame]:
    """Answers of a checker and their metrics: rows, per_label, summary (with kappa), confusion; unreadable answers are neutral."""
    answered = models.generate(pairs, prompt, client, "raw", "neutral").withColumn("pred", fallback_label(F.col("raw")))
    rows = cut_lineage(answered.select(prompt, label, "raw", "pred"))
    summary = metrics.macro(rows, label, "pred").crossJoin(F.broadcast(metrics.kappa(rows, label, "pred")))  # one row each
    return {"rows": rows, "per_label": metrics.per_label(rows, label, "pred"), "summary": summary, "confusion": metrics.confusion(rows, label, "pred")}


def evaluate_overlap(teacher: DataFrame, gold: DataFrame, key: str = "query_id", listed: str = "pred_claims", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Claim overlap of each query that both sides have, and its macro mean.  Of several rows of a query the last by ``order``
    counts, such as the position at which it was read; without one the largest list, so that the result does not depend on chance."""
    side = lambda d: d.groupBy(key).agg((F.max_by(listed, F.struct(order, listed)) if order else F.max(listed)).alias(listed)).select(key, F.transform(listed, text.claim_form).alias("claims"))
    per = metrics.overlap(side(teacher), side(gold), key, "claims")
    return per, per.agg(F.count("*").alias("n"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")))


def _claim_pairs(claims_: DataFrame, surfaces: DataFrame, vectors: DataFrame, eid: str, vec: str, most: int | None) -> DataFrame:
    """(claim, a, b, dist, score) of the entity pairs of each claim text."""
    found = linking.mentions(claims_, "claim", "claim_text", surfaces)
    ids = found.groupBy("claim").agg(F.array_sort(F.collect_set("eid")).alias("ids"))  # entities of one claim
    return kgscore.pair_scores(ids, "claim", "ids", vectors, eid, vec, most)


def legacy_fusion(students: DataFrame, surfaces: DataFrame, vectors: DataFrame, eid: str, vec: str, alpha: float = 0.8, tau: float = 0.3) -> DataFrame:
    """Claims (query_id, claim_idx, claim_text, nli, gold_label) with graph score, nli_label and additively fused label.

    Rows without all three probabilities are dropped; the score is the mean of the ten best entity pairs, 0 without two entities.
    """
    ok = students.where("nli.p_entailed IS NOT NULL AND nli.p_neutral IS NOT NULL AND nli.p_contradicted IS NOT NULL")
    c = fusion.probabilities(ok).withColumn("claim", F.concat_ws("#", "query_id", "claim_idx"))
    score = kgscore.claim_scores(_claim_pairs(c.select("claim", "claim_text"), surfaces, vectors, eid, vec, None), "claim", 10).select("claim", F.col("mean_top").alias("kg_score"))
    d = c.join(score, "claim", "left").withColumn("kg_score", F.coalesce("kg_score", F.lit(0.0)))
    d = d.withColumn("_f", scores.fuse_additive(F.col("pe"), F.col("pc"), F.col("pn"), F.col("kg_score"), alpha, tau))
    return d.withColumns({"nli_label": scores.argmax_ecn(F.col("pe"), F.col("pc"), F.col("pn")), "fused_label": scores.argmax_ecn(F.col("_f.e"), F.col("_f.c"), F.col("_f.n"))}).drop("_f", "claim")


def posthoc_fusion(students: DataFrame, surfaces: DataFrame, vectors: DataFrame, eid: str, vec: str, low: float = 0.25, high: float = 0.55) -> DataFrame:
    """(query_id, fused ARRAY): labels (query_id, labels ARRAY, claim_texts ARRAY) corrected by the best of up to 60 pair
    scores of each claim; claims without a pair keep their label."""
    e = students.select("query_id", F.posexplode(F.arrays_zip("labels", "claim_texts")).alias("pos", "x")).select("query_id", "pos", F.col("x.labels").alias("label"), F.col("x.claim_texts").alias("claim_text"))
    e = e.withColumn("claim", F.concat_ws("#", "query_id", "pos"))
    best = _claim_pairs(e.select("claim", "claim_text"), surfaces, vectors, eid, vec, 60).groupBy("claim").agg(F.max("score").alias("best"))
    f = e.join(best, "claim", "left").withColumn("fused", F.when(F.col("best").isNull(), F.col("label")).otherwise(scores.fuse_label(F.col("label"), F.col("best"), low, high)))
    return f.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fused"))), lambda s: s["fused"]).alias("fused"))  # claims of one query


# Relations that may hold between a head and a tail type.
RELATIONS = {("Compound", "Disease"): ("CtD", "CpD", "CcSE"), ("Compound", "Side Effect"): ("CcSE",), ("Gene", "Disease"): ("GaD",), ("Compound", "Gene"): ("CbG",)}


def soft_triples(triples: DataFrame, aliases: DataFrame, relation_bank: DataFrame, entity_vecs: DataFrame, relation_vecs: DataFrame, embedder=None, k: int = 5, m: int = 5, alpha: float = 0.5, allowed: dict = RELATIONS) -> DataFrame:
    """Best graph triple of each claim triple (claim, s, r, o): status, chosen entities and relation, text_sim, p_kge, dist, p_final.

    ``aliases`` (kind, entity, alias), ``relation_bank`` (relation, phrase) are embedded with the same model as the
    claims, each distinct string once; ``entity_vecs`` (entity, vec) and ``relation_vecs`` (relation, vec) score translations.
    """
    embedder = embedder or models.hashing_embedder()
    spark = triples.sparkSession
    parts = triples.select(F.explode(F.array("s", "r", "o")).alias("t"))
    strings = parts.unionByName(aliases.select(F.col("alias").alias("t"))).unionByName(relation_bank.select(F.col("phrase").alias("t"))).distinct()
    bank = cut_lineage(models.embed(strings, "t", embedder, "v"))
    with_vec = lambda d, c, out: d.join(bank.select(F.col("t").alias(c), F.col("v").alias(out)), c)
    al = with_vec(aliases, "alias", "av").select("kind", "entity", "av")
    cand = lambda side: kgscore.entity_candidates(with_vec(triples.select("claim", side), side, "qv"), "claim", "qv", al, "kind", "entity", "av", k)
    pairs = spark.createDataFrame([(i, h, t, r) for i, ((h, t), rs) in enumerate(allowed.items()) for r in rs], "ord int, hk string, tk string, relation string")
    cent = kgscore.centroids(with_vec(relation_bank, "phrase", "pv"), "relation", "pv")
    rel = with_vec(triples.select("claim", "r"), "r", "rv").crossJoin(F.broadcast(cent)).withColumn("rs", scores.dot(F.col("rv"), F.col("vec"))).select("claim", "relation", "rs")  # one row a relation
    rel = ranking.top_k(rel.join(pairs, "relation"), ["claim", "ord"], m, F.desc("rs"), F.asc("relation")).drop("rank")
    head = cand("s").select("claim", F.col("kind").alias("hk"), F.col("entity").alias("head"), F.col("sim").alias("hs"))
    tail = cand("o").select("claim", F.col("kind").alias("tk"), F.col("entity").alias("tail"), F.col("sim").alias("ts"))
    x = head.join(rel, ["claim", "hk"]).join(tail, ["claim", "tk"])
    ev = lambda c, v: entity_vecs.select(F.col("entity").alias(c), F.col("vec").alias(v))
    x = x.join(ev("head", "hv"), "head", "left").join(ev("tail", "tv"), "tail", "left").join(relation_vecs.select("relation", F.col("vec").alias("rvec")), "relation", "left")
    x = x.withColumn("text_sim", scores.text_score(F.col("hs"), F.col("ts"), F.col("rs"))).withColumn("dist", scores.translation_distance(F.col("hv"), F.col("rvec"), F.col("tv")))
    x = x.withColumn("p_kge", scores.translation_prob(F.col("dist"))).withColumn("p_final", scores.soft_score(F.col("p_kge"), F.col("text_sim"), alpha))
    best = kgscore.best_triple(x, "claim", "p_final", F.asc("ord"), F.asc("head"), F.asc("relation"), F.asc("tail"))
    out = triples.join(best.select("claim", "head", "relation", "tail", "text_sim", "p_kge", "dist", "p_final"), "claim", "left")
    return out.withColumn("status", F.when(F.col("head").isNull(), "no_candidate").otherwise("ok"))
