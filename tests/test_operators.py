"""Small fixtures for retrieval, linking, scores, metrics, ranking, context."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlake.functions import text
from claimlake.operators import claims, context, corpus, kgscore, linking, metrics, paths, ranking, retrieval, unify


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rrf_golden(spark):
    runs = spark.createDataFrame([(1, "a", 0.5, 1, 1.0, 0), (1, "b", 0.4, 2, 1.0, 0), (1, "b", 9.0, 1, 1.2, 1), (1, "c", 8.0, 2, 1.2, 1), (1, "a", 7.0, 3, 1.2, 1)], "q int, d string, score double, rank int, weight double, run_no int")
    got = {r.d: (round(r.rrf_score, 6), r.score, r["rank"]) for r in retrieval.reciprocal_rank(runs, "q", "d", 10).collect()}
    assert got == {"b": (0.035801, 0.4, 1), "a": (0.035441, 0.5, 2), "c": (0.019355, 8.0, 3)}
    assert retrieval.weights("gold=1.0,dense=1.2") == {"gold": 1.0, "dense": 1.2}


def test_bm25_against_formula(spark):
    docs = [(1, "a b b"), (2, "a c"), (3, None), (4, "d d d e")]
    c = spark.createDataFrame(docs, "id int, t string")
    q = spark.createDataFrame([(9, "b b d"), (8, ""), (7, None)], "qid int, q string")
    got = {(r.qid, r.id): r.score for r in retrieval.bm25(q, "qid", "q", c, "id", "t", 5).collect()}
    toks = {i: (t or "").split() for i, t in docs}
    n, avg = 4, sum(map(len, toks.values())) / 4
    idf = {w: math.log(n - df + 0.5) - math.log(df + 0.5) for w in "abcde" for df in [sum(w in x for x in toks.values())]}
    mean = sum(idf.values()) / 5
    want = {}
    for i, t in toks.items():
        s = sum((idf[w] if idf[w] >= 0 else 0.25 * mean) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in "bbd")
        if any(w in t for w in "bd"):
            want[9, i] = s
    assert got == pytest.approx(want)


def test_dense_blocks_match_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    q = e.where("id % 10 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = {(r.q, r.id) for r in retrieval.dense(q, "q", "qv", e, "id", "v", 5).collect()}
    assert got == {(i, int(j)) for i in range(0, 60, 10) for j in np.argsort(-(v @ v[i]))[:5]}


def test_dense_beyond_the_broadcast_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(40, 4)), 3, axis=0)  # every vector three times: ties go to the smaller id
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, v array<double>")
    q = e.where("id % 10 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    want = {(i, int(j)) for i in range(0, 120, 10) for j in np.lexsort((np.arange(120), -np.round(v @ v[i], 9)))[:4]}
    run = lambda: {(r.q, r.id) for r in retrieval.dense(q, "q", "qv", e, "id", "v", 4).collect()}
    assert run() == want
    monkeypatch.setattr(retrieval, "SENT_BYTES", 8)
    monkeypatch.setattr(retrieval, "MEETING", 16)
    assert run() == want


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 16))
    v = np.r_[v, v + 0.05 * rng.normal(size=v.shape)]
    v /= np.linalg.norm(v, axis=1)[:, None]
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    s = v @ v.T
    for exact, least, tile in ((False, 0.95, 2048), (False, 0.95, 4), (True, 0.5, 7)):
        got = {(r.a, r.b) for r in retrieval.near_vectors(e, "id", "v", least, exact=exact, tile=tile).collect()}
        assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= least}


def test_bm25_salted_join_is_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"drug pain {'common ' * (i % 3)}w{i % 5}") for i in range(40)], "id long, t string")
    q = spark.createDataFrame([(1, "common w1"), (2, "w1 common"), (3, None)], "q int, t string")
    run = lambda: sorted((r.q, r.id, round(r.score, 9), r["rank"]) for r in retrieval.bm25(q, "q", "t", d, "id", "t", 5).collect())
    want = run()
    monkeypatch.setattr(retrieval, "SENT", 0)
    assert want and run() == want


def test_hybrid_degenerate(spark):
    d = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "q int, d int, score double")
    s = spark.createDataFrame([(1, 2, 3.0), (1, 3, 1.0)], "q int, d int, score double")
    assert [(r.d, r.score) for r in retrieval.hybrid(d, s, "q", "d", 0.65, 5).orderBy("rank").collect()] == [(2, 0.35), (1, 0.0), (3, 0.0)]


def test_metrics_golden(spark):
    true, pred = "EEECCNNNNN", "EENCENNNCN"
    name = {"E": "entailed", "C": "contradicted", "N": "neutral"}
    p = spark.createDataFrame([(name[a], name[b]) for a, b in zip(true, pred)], "y string, p string")
    m = metrics.macro(p, "y", "p").first()
    assert (m.n, round(m.accuracy, 6), round(m.macro_f1, 6)) == (10, 0.7, 0.655556)
    assert round(metrics.kappa(p, "y", "p").first().kappa, 6) == 0.516129
    assert {r.y_true: r.entailed for r in metrics.confusion(p, "y", "p").collect()} == {"entailed": 2, "contradicted": 1, "neutral": 0}
    empty = p.where("false")
    assert metrics.kappa(empty, "y", "p").first().kappa == 0.0
    assert metrics.macro(empty, "y", "p").first().macro_f1 == 0.0


def test_advantage_and_ema(spark):
    s = spark.createDataFrame([(1, 1.0), (1, -1.0), (1, -1.0), (2, 5.0)], "g int, v double")
    got = sorted(round(r.advantage, 4) for r in metrics.advantages(s, "g", "v").collect())
    assert got == pytest.approx([-0.57735, -0.57735, 0.0, 1.1547], abs=2e-4)
    e = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (1, 3, 1.0)], "k int, t int, v double")
    assert round(metrics.last_ema(e, "k", "v", [F.col("t")], 0.1).first().ema, 6) == 0.91
    many = spark.createDataFrame([(i % 3, i, float(i * 7 % 11)) for i in range(60)], "k int, t int, v double")
    whole = {r.k: round(r.ema, 9) for r in metrics.last_ema(many, "k", "v", [F.col("t")], 0.1).collect()}
    assert whole == {r.k: round(r.ema, 9) for r in metrics.last_ema(many, "k", "v", [F.col("t")], 0.1, F.floor(F.col("t") / 7)).collect()}


def test_context_metrics_worked_example(spark):
    # ten chunks, five of them entail a gold claim; three of five claims supported, two refuted
    gains = spark.createDataFrame([(1, r, int(r <= 5)) for r in range(1, 11)], "q int, rank int, gain int")
    c = spark.createDataFrame([(1, 3, 2, 3, 3, 5, 5)], "q int, supported int, refuted int, gold_covered int, used int, n_claims int, n_gold int")
    m = metrics.context_metrics(c, gains, "q", 10).first()
    assert [round(x, 2) for x in (m.context_precision, m.faithfulness, m.hallucination, m.claim_recall, m.context_utilisation)] == [0.5, 0.6, 0.4, 0.6, 0.6]
    assert m.ndcg == pytest.approx(1.0) and m.recall_at_k == 1.0


def test_index_modes(spark):
    k = spark.createDataFrame([("a", -0.5, True, False), ("a", 0.7, False, False), ("b", None, False, False), (None, 1.0, True, True), ("c", float("nan"), None, True)], "query_id string, p_final double, node_hit boolean, pair_hit boolean")
    got = {r.query_id: (r.score, r.hit_type) for r in kgscore.index(k).collect()}
    assert got == {"a": (0.7, "node"), "b": (0.0, "none"), "c": (0.0, "pair")}
    assert {r.query_id: r.score for r in kgscore.index(k, hit_only=True).collect()} == {"a": -0.5, "b": 0.0, "c": 0.0}
    assert {r.query_id: round(r.score, 3) for r in kgscore.index(k, agg="mean_topk", k=2).collect()} == {"a": 0.1, "b": 0.0, "c": 0.0}
    with pytest.raises(ValueError):
        kgscore.index(k, agg="other")


def test_linking(spark):
    names = spark.createDataFrame([("Foo  Bar", "7", 1), ("foo bar", "8", 2), ("nan", "1", 3), ("baz", "x", 4)], "name string, entity_id string, n int")
    e = spark.createDataFrame([("x", 5)], "name string, eid long")
    assert rows(linking.resolve_names(names.select("name", "entity_id", "n"), e, F.col("n"), ("id",))) == [("foo bar", 8)]
    assert rows(linking.resolve_names(names.select("name", F.col("entity_id").alias("second"), "n"), e, F.col("n"), ("entity", "second"))) == [("baz", 5)]
    t = spark.createDataFrame([(1, "Treats foo bar, baz"), (2, None)], "q int, t string")
    s = spark.createDataFrame([("foo bar", 8), ("baz", 5), ("bar baz x", 9)], "surface string, eid long")
    assert rows(linking.mentions(t, "q", "t", s)) == [(1, 5), (1, 8)]
    p = spark.range(1).select(linking.entity_pairs(F.array(*map(F.lit, (1, 2, 3))), 2).alias("p")).first().p
    assert [(x.a, x.b) for x in p] == [(1, 2), (1, 3)]


def test_hash_rank_is_a_rank(spark):
    d = spark.range(500).withColumn("k", (F.col("id") % 3 == 0).cast("int"))
    r = ranking.hash_rank(d, ["k"], F.md5(F.col("id").cast("string"))).collect()
    import hashlib

    for k in (0, 1):
        own = sorted((x for x in r if x.k == k), key=lambda x: x["rank"])
        assert [x["rank"] for x in own] == list(range(1, len(own) + 1))
        h = [hashlib.md5(str(x.id).encode()).hexdigest() for x in own]
        assert h == sorted(h)


def test_rebalance_and_split(spark):
    d = spark.createDataFrame([(i, "entailed" if i < 7 else "neutral" if i < 9 else "contradicted") for i in range(12)], "i int, label string")
    down = ranking.rebalance(d, "label", F.col("i"), "down", text.LABELS).groupBy("label").count()
    assert {r["count"] for r in down.collect()} == {2}
    up = ranking.rebalance(d, "label", F.col("i"), "up", text.LABELS).groupBy("label").count()
    assert {r["count"] for r in up.collect()} == {7}
    assert ranking.rebalance(d.where("label <> 'neutral'"), "label", F.col("i"), "down", text.LABELS).count() == 10
    parts = ranking.split_share(d, F.col("i"), 0.95).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 11, "eval": 1}
    assert ranking.split_share(d.limit(1), F.col("i"), 0.5).first().part == "train"


def test_claims(spark):
    d = spark.createDataFrame([('[["a","r","b"],"plain",["x","y"]]',), ('[["a",null,"b"],["","r","o"]]',), (None,)], "j string").withColumn("v", F.try_parse_json("j"))
    got = d.select(claims.coerce(F.col("v")).alias("s"), claims.triples(F.col("v")).alias("t")).collect()
    assert got[0].s[:2] == ["a r b.", "plain"] and got[0].t == [["a", "r", "b"]]
    assert got[1].t == [["a", "None", "b"]] and got[2].s == [] and got[2].t == []
    c = spark.range(1).select(claims.distinct_claims(F.array(*map(F.lit, ("A  b", "a B", " ", "c")))).alias("x")).first().x
    assert c == ["A b", "c"]
    labels = F.create_map(F.lit("D1"), F.lit("Neutral"), F.lit("d2"), F.lit("Entailment"))
    k = F.array(F.lit("d1"), F.lit("d2"), F.lit("d2"), F.lit(None).cast("string"))
    assert spark.range(1).select(claims.align(k, labels).alias("x")).first().x == ["Neutral", None, "Entailment", None]
    shapes = {'{"response_claims":[],"claims":["z"]}': [], '{"claims":["p ","q"]}': ["p", "q"], '{"response_claims":[["a","b"],"c"]}': ["a b", "c"], "{}": []}
    s = spark.createDataFrame([(x,) for x in shapes], "j string").select("j", claims.shaped(F.try_parse_json("j")).alias("x")).collect()
    assert {r.j: r.x for r in s} == shapes
    docs = {'{"text":" a  b "}': "a b", '{"text":"","meta":{"title":"t"}}': "t", '{"x":"' + "w" * 25 + '","n":3}': "w" * 25, "{}": ""}
    s = spark.createDataFrame([(x,) for x in docs], "j string").select("j", claims.evidence_text(F.try_parse_json("j")).alias("x")).collect()
    assert {r.j: r.x for r in s} == docs


def test_checker_pairs_alignment(spark):
    long = "evidence text that is certainly longer than forty characters"
    d = spark.createDataFrame([(1, ["A.", "a.", "B."], ["short", long], [["Neutral", "Entailment"], ["x", "y"], ["Neutral", "contradiction"]])], "q int, c array<string>, e array<string>, l array<array<string>>")
    got = [(r.claim_no, r.doc_no, r.label) for r in claims.checker_pairs(d, "q", "c", "e", "l").collect()]
    assert got == [(0, 1, "entailed"), (2, 1, "contradicted")]
    shifted = [(r.claim_no, r.doc_no, r.label) for r in claims.checker_pairs(d, "q", "c", "e", "l", compat=True).collect()]
    assert shifted == [(0, 0, "neutral")]


def test_chunks(spark):
    para = "\n\n".join("word " * n for n in (50, 150, 400, 3))
    for t in (para, "x" * 2500, "a b " * 900, "", "short"):
        parts = corpus.split_text(t)
        assert all(0 < len(p) <= 1000 for p in parts)
        assert set("".join(parts)) <= set(t)
        assert set(t.split()) == set(" ".join(parts).split()) or "x" in t
    d = spark.createDataFrame([(1, para), (2, None)], "id int, t string")
    c = corpus.chunks(d, "id", "t").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in c] == list(range(c[0].num_chunks))


def test_context_packing_never_overflows(spark):
    docs = [None, "a" * 700, "b" * 1500, "c" * 10]
    d = spark.createDataFrame([("q" * 20, docs), ("q" * 5000, docs), ("", [])], "q string, t array<string>")
    for window in (600, 1024, 4096):
        r = d.select("q", context.pack(F.col("q"), F.col("t"), window, 128, 64, 8, 1200).alias("p"), context.trim_to_limit(F.col("q"), F.col("t"), window, 128).alias("x")).collect()
        for x in r:
            n = sum(len(p) + 2 for p in x.p) + 2 * max(0, len(x.p) - 1)
            assert not x.p or max(1, (context.PROMPT_CHARS + len(x.q) + n) // 4) <= window - 192
            assert x.x == docs[: len(x.x)] if x.q else x.x == []
    assert d.select(context.pack_numbered(F.col("t")).alias("s")).first().s.startswith("[Doc 2]\naaa")


def test_prompts(spark):
    p = spark.range(1).select(context.answer_prompt(F.lit("Q?"), F.array(F.lit("a"), F.lit(None).cast("string"))).alias("p")).first().p
    assert p == context.ANSWER_PROMPT.format(question="Q?", context="- a\n\n- ")
    t = spark.range(1).select(claims.pair_text(F.lit("doc"), F.lit("c"), F.lit("e")).alias("t")).first().t
    assert t.endswith("Claim:\nc\n\nEvidence:\ne\n")


def test_unify_shapes(spark):
    raw = ['{"pubid":7,"question":"","QUESTION":"q","context":{"contexts":["a","b"]},"long_answer":"","answer":"z","final_decision":"yes"}', '{"id":"x","context":"[\\"c\\"]"}', '{"id":"y","context":"plain"}', "{}"]
    d = spark.createDataFrame([(x,) for x in raw], "j string").select(F.parse_json("j").alias("v"))
    got = [(r.id, r.question, r.contexts, r.answer, r.label) for r in unify.abstracts(d, "v", "s").collect()]
    assert got == [("7", "q", ["a", "b"], "z", "yes"), ("x", "", ["c"], "", None), ("y", "", ["plain"], "", None), ("", "", [], "", None)]
    raw = ['{"QUESTION_ID":"1","NIST_PARAPHRASE":" p ","ORIGINAL_QUESTION_SUBJECT":"s","ORIGINAL_QUESTION_MESSAGE":"","REFERENCE_ANSWERS":[{"ANSWER":"a","AnswerURL":"u"},{"ANSWER":"b"}]}', '{"QUESTION_ID":"2","ORIGINAL_QUESTION_SUBJECT":"s","ORIGINAL_QUESTION_MESSAGE":"m"}']
    d = spark.createDataFrame([(x,) for x in raw], "j string").select(F.parse_json("j").alias("v"))
    got = [(r.id, r.question, r.contexts, r.answer) for r in unify.live(d, "v").collect()]
    assert got == [("1", "p", ["[SUBJECT] s"], "a"), ("2", "s m", ["[SUBJECT] s", "[MESSAGE] m"], "")]
    assert unify.live(d, "v", join_all=True).first().answer == "a\n\nb"
    d = spark.createDataFrame([(3, '{"question":" q ","document":"","response":"r"}')], "pos int, j string").select("pos", F.parse_json("j").alias("v"))
    r = unify.local(d, "v", "pos", "val").first()
    assert (r.id, r.question, r.contexts, r.answer) == ("3", "q", [], "r")


def test_paths(spark):
    d = spark.createDataFrame([("/r/eval_m-4.1-G-8B/m_train.G-8B.x/text_eval/f.json",)], "p string")
    assert tuple(d.select(*paths.run_columns(F.col("p"))).first()) == ("m", "4.1", "G-8B", "m_train", "G-8B")
