"""Accessors over drifting files: edge cases."""

from pyspark.sql import functions as F

from claimlake.operators import accessors, corpus, paths


def parsed(spark, *texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").withColumn("v", F.try_parse_json("t"))


def test_hits_and_probabilities(spark):
    d = parsed(spark, '{"kg_hit": null, "kg_score": 1}', '{"kg_hit": "yes"}', '{"kg_score": "nan"}', "[1]", "{bad", None, '{"probs": {"entailed": "x"}, "nli": {"p_entailed": 1}}', '{"kg_fused": {"p_entailed": 1}, "fused": {"p_entailed": 1, "p_neutral": 0, "p_contradicted": 0}}')
    v = F.col("v")
    r = d.select("i", accessors.graph_hit(v).alias("h"), accessors.claim_probabilities(v).alias("p"), accessors.fused_probabilities(v).alias("f")).orderBy("i").collect()
    assert [bool(x.h) for x in r] == [False, True, False, False, False, False, False, False]
    assert r[6].p.e == 0 and r[7].f is None and all(x.p.e == 0 for x in r)


def test_parameters_look_at_the_first_claims_only(spark):
    d = parsed(spark, "[" + ",".join(['{"kg_fused": {}}'] * 50 + ['{"kg_fused": {"alpha": 1}}']) + "]", '[{"kg_fused": {"alpha": 0.5, "beta": 0.6}}]', "[]").withColumn("doc", F.parse_json(F.lit("{}")))
    r = d.select("i", accessors.fusion_parameters(F.col("doc"), F.col("v").cast("array<variant>")).alias("p")).orderBy("i").collect()
    assert [(x.p.alpha, x.p.beta, x.p.fusion_type) for x in r] == [(None, None, "unknown"), (0.5, None, "alpha"), (None, None, "unknown")]


def test_grouped_f1_and_error_rate_without_rows(spark):
    d = spark.createDataFrame([("a", None, "entailed"), ("b", "entailed", "entailed"), ("b", "neutral", None)], "g string, y string, p string")
    m = {r.g: r for r in accessors.grouped_f1(d, ["g"], "y", "p").collect()}
    assert m["a"].n == 0 and m["a"].macro_f1 is None and m["b"].accuracy == 0.5 and round(m["b"].macro_f1, 6) == 0.333333
    e = {r.g: r for r in accessors.error_rate(d, ["g"], F.col("y").isNotNull(), F.col("y") != F.col("p")).collect()}
    assert e["a"].error_rate is None and e["b"].error_rate == 0.0
    assert accessors.grouped_f1(d.where("false"), [], "y", "p").first().macro_f1 is None


def test_cleanup_and_capped_fetch(spark):
    f = spark.createDataFrame([("/a/x__kgfused__kgfused.json",), ("/a/x__kgfused__kgfused__kgfused.json",), (None,)], "file string")
    assert {(r.action, r.target) for r in paths.cleanup(f.where("file IS NOT NULL")).collect()} == {("rename", "/a/x__kgfused.json"), ("delete", "/a/x__kgfused.json")}
    u = spark.createDataFrame([("i", f"u{n}") for n in range(9)] + [("i", "u0"), ("j", None), ("k", "bad")], "item string, url string")

    def client():
        def get(x):
            if x == "bad":
                raise OSError("gone")
            return x * 3

        return get

    got = {(r.item, r.url): r.page for r in corpus.fetch_items(u, "item", "url", client, 3, 4).collect()}
    assert got == {("i", "u0"): "u0u0", ("i", "u1"): "u1u1", ("i", "u2"): "u2u2", ("k", "bad"): None}
