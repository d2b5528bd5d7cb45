"""Readers, writers, model hooks, streams and pipelines on files in temporary folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlake.functions import models
from claimlake.plans import pipelines
from claimlake.sources import readers, writers
from claimlake.streaming import events

LONG = "evidence that is certainly longer than forty characters in all"


def test_lines_and_counters(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"query_id":"a","p_final":0.5,"node_hit":true}\n\n{bad\n{"p_final":1}\n{"query_id":"b","score":0.2,"pair_hit":"yes"}\n{"query_id":"c"}\n')
    d = readers.lines(spark, str(tmp_path / "s.jsonl"))
    c = readers.line_counters(d).first()
    assert (c.n_lines, c.n_parse_err, c.n_missing_qid, c.n_missing_score, c.used_p_final, c.used_score) == (6, 1, 1, 1, 1, 1)
    got = {r.query_id: (r.p_final, r.node_hit, r.pair_hit) for r in readers.scores(d).collect()}
    assert got == {"a": (0.5, True, False), "b": (0.2, False, True), "c": (None, False, False)}
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, str(tmp_path / "s.jsonl"), "query_id string").collect()


def test_documents(spark, tmp_path):
    sub = tmp_path / "eval_m-t-g" / "m_train.g.x" / "text_eval"
    sub.mkdir(parents=True)
    rec = {"query_id": "q1", "query": "What?", "response": "An answer of enough length.", "gt_answer": "Gold.", "response_claims": [["a", "treats", "b"], "Plain claim"], "gt_answer_claims": [["g", "is", "h"]], "retrieved_context": [{"text": LONG, "doc_id": "D1"}, {"text": "short"}], "retrieved2response": [["Entailment", "Neutral"], {"d1": "Contradiction"}], "metrics": {"hallucination": 0.25, "faithfulness": 0.5}}
    (sub / "results_text.json").write_text(json.dumps({"metrics": {"overall": 1}, "results": [rec, rec]}))
    (tmp_path / "broken.json").write_text("{bad")
    docs = readers.documents(spark, str(tmp_path))
    assert docs.count() == 1 and readers.results(docs).count() == 2
    rec["retrieved2response"] = [["Entailment", "Neutral"], ["Neutral"]]
    (sub / "results_text.json").write_text(json.dumps({"results": [rec, rec]}))
    out = pipelines.distillation(readers.documents(spark, str(tmp_path)))
    assert {r.label for r in out["checker"].collect()} == {"entailed", "neutral"}
    assert out["extractor"].first().output == '[["g", "is", "h"]]'
    assert out["teacher_claims"].first().pred_claims == ["a treats b.", "Plain claim"]
    assert out["counts"].first().n_rows == 1 and out["infer_inputs"].count() == 1
    rows = pipelines.distinct_rows(pipelines.evaluated(readers.documents(spark, str(tmp_path))))
    surfaces = spark.createDataFrame([("a", 1), ("b", 2)], "surface string, eid long")
    vecs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "e long, v array<double>")
    q, p = pipelines.score_questions(rows, surfaces, vecs, "e", "v")
    assert tuple(q.first()) == ("q1", 2, True, True) and round(p.first().score, 6) == 0.166667
    s = pipelines.run_summary(rows, q).first()
    assert (s.cov_pair, s.hall_kg, s.dataset, s.teacher, s.generator) == (100.0, 25.0, "m", "t", "g")


def test_label_tables_by_key(spark, tmp_path):
    rec = {"query_id": "q", "query": "?", "response": "r" * 20, "response_claims": ["one claim"], "retrieved_context": [{"text": LONG, "doc_id": "D1"}], "retrieved2response": [{"d1": "Contradiction"}]}
    (tmp_path / "results.json").write_text(json.dumps({"results": [rec]}))
    out = pipelines.distillation(readers.documents(spark, str(tmp_path)))
    assert [r.label for r in out["checker"].collect()] == ["contradicted"]


def test_rooted_and_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"root":[{"x":1}]}')
    (tmp_path / "b.json").write_text('[{"x":2},{"x":3}]')
    (tmp_path / "c.json").write_text('"other"')
    assert readers.rooted(readers.documents(spark, str(tmp_path))).count() == 3
    assert [r.pos for r in readers.array_file(spark, str(tmp_path / "b.json"), 1).collect()] == [0]
    with pytest.raises(Exception):
        readers.array_file(spark, str(tmp_path / "c.json")).collect()


def test_small_files(spark, tmp_path):
    f = spark.createDataFrame([("/a/soft-x.jsonl",), ("/a/soft.jsonl",), ("/b/soft-y.jsonl",), ("/c/other",)], "file string")
    got = {r.folder: r.file for r in readers.preferred_file(f, ["soft.jsonl", "soft-*.jsonl"]).collect()}
    assert got == {"/a": "/a/soft.jsonl", "/b": "/b/soft-y.jsonl"}
    (tmp_path / "e.tsv").write_text("x\t1\ny\t2\n")
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "e.tsv")).collect()] == [("x", 1), ("y", 2)]
    assert readers.numbered_lines(spark, str(tmp_path / "e.tsv")).where("line <> ''").count() == 2
    m = np.arange(12, dtype=np.float32).reshape(6, 2)
    np.save(tmp_path / "m.npy", m)
    assert {r.idx: list(r.vec) for r in readers.npy(spark, str(tmp_path / "m.npy")).collect()} == {i: x.tolist() for i, x in enumerate(m)}
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([("q", True, False)], "query_id string, node_hit boolean, pair_hit boolean")

    for force in (False, False, True):
        d = readers.cached_scores(spark, str(tmp_path / "cache"), compute, force)
    assert len(calls) == 2 and tuple(readers.hit_sets(d).first()) == ("q", True, False)
    t = spark.createDataFrame([("a", "x", "yes"), ("", "x", "yes"), ("b", "x", "other")], "c string, e string, l string")
    assert readers.labelled(t, ["c", "e"], "l", ("yes",)).count() == 1


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(2, "é", None), (1, "b_c", 0.5)], "i int, s string, x double")
    writers.jsonl(d, str(tmp_path / "j"))
    writers.jsonl(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.jsonl(d, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert any("é" in p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("*.json"))
    writers.document(d, str(tmp_path / "d"), ["i"])
    assert [r["i"] for r in json.loads(next((tmp_path / "d").glob("part*")).read_text())["results"]] == [1, 2]
    writers.csv(d, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    writers.rows_and_summary(d, d.agg(F.count("*").alias("n")), str(tmp_path / "rs"))
    assert spark.read.json(str(tmp_path / "rs/summary")).first().n == 2
    writers.by_run(d, str(tmp_path / "r"), "i")
    assert spark.read.parquet(str(tmp_path / "r")).where("i = 1").count() == 1
    writers.index(d, str(tmp_path / "ix"))
    tex = writers.latex(d, ["s", "x"], 2, "Runs", "i")
    assert r"b\_c & 0.50 \\" in tex and r"é & -- \\" in tex


def test_models(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string")
    v = models.embed(d, "t", models.hashing_embedder(8)).orderBy("i").collect()
    assert round(sum(x * x for x in v[0].vec), 5) == 1.0 and not any(v[1].vec)

    def client():
        def call(p):
            if p is None:
                raise ValueError
            return p.upper()

        return call

    assert [r.answer for r in models.generate(d, "t", client, default="neutral").orderBy("i").collect()] == ["A B", "neutral"]
    pages = spark.createDataFrame([("k", "u", "<p>" + "word " * 400 + "</p>"), ("k", "u", "<p>x</p>" + "word " * 400), ("k2", "", "x")], "id string, url string, html string")
    c = pipelines.build_corpus(pages, "id", "url", "html").collect()
    assert {r.num_chunks for r in c} == {len(c)} and all(len(r.text) <= 1000 for r in c)
    assert [r.x for r in spark.createDataFrame([("yes",), ("?",)], "a string").select(pipelines.fallback_label(F.col("a")).alias("x")).collect()] == ["entailed", "neutral"]


def test_fuse_file(spark):
    s = spark.createDataFrame([("f__checker_sft_m.json", "q1", 0, (0.6, 0.3, 0.1)), ("f__checker_sft_m.json", "q2", 0, (0.0, 0.0, 0.0))], "file string, query_id string, claim_idx int, nli struct<p_entailed double, p_neutral double, p_contradicted double>")
    k = spark.createDataFrame([("q1", 0.9, True, False)], "query_id string, p_final double, node_hit boolean, pair_hit boolean")
    f = {r.query_id: r for r in pipelines.fuse_file(s, k).collect()}
    assert round(f["q1"].fe, 6) == 0.682182 and (f["q2"].fe, f["q2"].fused_label) == (0.0, "entailed")
    x = pipelines.summarise(pipelines.fuse_file(s, k)).first()
    assert (x.n_claims, x.kg_hit_claim_rate, x.method) == (2, 0.5, "sft")
    assert pipelines.fuse_file(s, k, calibration="sigmoid").count() == 2


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 0.0), (1, "2024-01-01 00:20:00", 1.0), (2, "2024-01-01 02:00:00", 3.0)], "k int, t string, v double").withColumn("t", F.to_timestamp("t"))
    d.write.parquet(str(tmp_path / "in"))
    s = lambda: events.arriving(spark, str(tmp_path / "in"), d.schema)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert run(events.once(s(), ["k"], "t"), "once", "append").__len__() == 2
    assert {(r.k, r.n) for r in run(events.windows(s(), "t", "k", "v"), "win", "complete")} == {(1, 3), (2, 1)}
    ema = {r.k: round(r.ema, 6) for r in run(events.running_ema(s(), "k", "t", "v", 0.1), "ema", "update")}
    assert ema == {1: 0.91, 2: 3.0}


def test_datasets(spark, tmp_path):
    from claimlake.sources import datasets

    (tmp_path / "a.jsonl").write_text('{"pubid":1,"question":"q","long_answer":"a"}\n{bad\n{"pubid":2}\n')
    assert [r.id for r in datasets.abstracts(spark, str(tmp_path / "a.jsonl")).orderBy("id").collect()] == ["1", "2"]
    assert datasets.abstracts(spark, str(tmp_path / "a.jsonl"), limit=0).count() == 1
    spark.createDataFrame([("7", "q", "a", "c")], "question_id string, question string, answer string, category string").write.parquet(str(tmp_path / "p.parquet"))
    r = datasets.pages(spark, str(tmp_path / "p.parquet")).select("id", F.try_variant_get("metadata", "$.category", "string").alias("c")).first()
    assert tuple(r) == ("7", "c")
    assert datasets.live(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "s.json").write_text('[{"question":"x","document":"d","response":"r"}]')
    assert datasets.local_split(spark, str(tmp_path / "s.json"), "val").first().contexts == ["d"]


def echo(answer):
    def client():
        return lambda p: answer

    return client


def test_rag_and_generation(spark):
    items = spark.createDataFrame([("q1", "Q?", "gold"), ("q2", "Q2?", "g")], "id string, question string, answer string")
    docs = spark.createDataFrame([(1, "text one", "t1", "s"), (2, None, None, None)], "doc_id int, text string, title string, source string")
    a = spark.createDataFrame([("q1", 1, 0.9, 1), ("q1", 2, 0.8, 2)], "query_id string, doc_id int, score double, rank int")
    b = spark.createDataFrame([("q1", 2, 5.0, 1)], "query_id string, doc_id int, score double, rank int")
    rows = pipelines.rag_inputs(items, {"dense": a, "bm25": b}, docs, 8, "bm25=2.0")
    got = {r.query_id: [x.doc_id for x in r.retrieved_context] for r in rows.collect()}
    assert got == {"q1": ["2", "1"], "q2": []}
    out = {r.query_id: (r.rag_response, r._skipped_overflow) for r in pipelines.generate_answers(rows, echo("yes")).collect()}
    assert out == {"q1": ("yes", False), "q2": ("yes", False)}
    long = rows.withColumn("query", F.repeat(F.lit("x"), 20000))
    assert {(r.rag_response, r._skipped_overflow) for r in pipelines.generate_answers(long, echo("yes")).collect()} == {("", True)}


def test_evaluation_drivers(spark):
    p = spark.createDataFrame([("a", "entailed"), ("b", "neutral")], "prompt string, label string")
    e = pipelines.evaluate_checker(p, echo("Label: entailed."))
    assert e["summary"].first().accuracy == 0.5 and e["rows"].count() == 2 and e["confusion"].count() == 3
    t = spark.createDataFrame([("q", ["A b.", "c"])], "query_id string, pred_claims array<string>")
    g = spark.createDataFrame([("q", ["a  b", "d"]), ("z", ["x"])], "query_id string, pred_claims array<string>")
    per, mean = pipelines.evaluate_overlap(t, g)
    assert (per.first().tp, per.first().fp, mean.first().f1) == (1, 1, 0.5)


def test_claim_fusion_drivers(spark):
    surfaces = spark.createDataFrame([("aspirin", 1), ("pain", 2)], "surface string, eid long")
    vecs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.1, 0.0])], "e long, v array<double>")
    nli = "struct<p_entailed double, p_neutral double, p_contradicted double>"
    s = spark.createDataFrame([("q", 0, "Aspirin treats pain.", (0.3, 0.2, 0.5), "entailed"), ("q", 1, "Nothing here", (0.3, 0.2, 0.5), None), ("q", 2, "x", (None, 0.1, 0.1), None)], f"query_id string, claim_idx int, claim_text string, nli {nli}, gold_label string")
    got = {r.claim_idx: (r.nli_label, r.fused_label) for r in pipelines.legacy_fusion(s, surfaces, vecs, "e", "v").collect()}
    assert got == {0: ("contradicted", "entailed"), 1: ("contradicted", "contradicted")}
    p = spark.createDataFrame([("q", ["Neutral", "Entailment"], ["Aspirin treats pain.", "Nothing"])], "query_id string, labels array<string>, claim_texts array<string>")
    assert pipelines.posthoc_fusion(p, surfaces, vecs, "e", "v").first().fused == ["Entailment", "Entailment"]


def test_soft_triples(spark):
    t = spark.createDataFrame([(1, "aspirin", "treats", "headache"), (2, "zzz", "qqq", "www")], "claim int, s string, r string, o string")
    al = spark.createDataFrame([("Compound", "C1", "aspirin"), ("Compound", "C2", "ibuprofen"), ("Disease", "D1", "headache"), ("Disease", "D2", "fever")], "kind string, entity string, alias string")
    bank = spark.createDataFrame([("CtD", "treats"), ("CpD", "relieves")], "relation string, phrase string")
    ev = spark.createDataFrame([("C1", [0.0, 0.0]), ("D1", [1.0, 0.0]), ("C2", [5.0, 5.0])], "entity string, vec array<double>")
    rv = spark.createDataFrame([("CtD", [1.0, 0.0])], "relation string, vec array<double>")
    r = {x.claim: x for x in pipelines.soft_triples(t, al, bank, ev, rv).collect()}
    assert (r[1].head, r[1].relation, r[1].tail, r[1].status) == ("C1", "CtD", "D1", "ok") and r[1].dist == 0.0
    assert r[2].status == "ok" and r[2].p_final >= 0
