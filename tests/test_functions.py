"""Golden values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from claimlake.functions import scores, text


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


@pytest.mark.parametrize(
    "e,n,c,s,b,want,label",
    [
        (0.6, 0.3, 0.1, 0.9, 0.8, (0.682182, 0.238364, 0.079455), "entailed"),
        (0.6, 0.3, 0.1, 0.9, 1.0, (0.6, 0.3, 0.1), "entailed"),
        (0.3, 0.5, 0.2, 0.95, 0.5, (0.7405, 0.185357, 0.074143), "entailed"),
        (0.0, 0.0, 0.0, 0.9, 0.8, (0.471263, 0.264368, 0.264368), "entailed"),
        (1.0, 0.0, 0.0, 0.01, 0.5, (0.990148, 0.004926, 0.004926), "entailed"),
        (0.2, 0.2, 0.6, 0.0, 0.8, (0.020389, 0.244903, 0.734708), "contradicted"),
    ],
)
def test_logit_fusion(spark, e, n, c, s, b, want, label):
    r = one(spark, scores.fuse_logit(F.lit(e), F.lit(n), F.lit(c), F.lit(s), b)).c0
    assert (round(r.e, 6), round(r.n, 6), round(r.c, 6)) == pytest.approx(want, abs=2e-6)
    assert one(spark, scores.argmax_enc(F.lit(r.e), F.lit(r.n), F.lit(r.c))).c0 == label
    assert r.e + r.n + r.c == pytest.approx(1.0)


def test_additive_and_threshold(spark):
    r = one(spark, scores.fuse_additive(F.lit(0.3), F.lit(0.5), F.lit(0.2), F.lit(0.8), 0.8, 0.3)).c0
    assert (round(r.e, 6), round(r.c, 6), round(r.n, 6)) == (0.5, 0.357143, 0.142857)
    f = lambda x, s: one(spark, scores.fuse_label(F.lit(x), F.lit(s))).c0
    assert [f("Entailment", 0.2), f("Neutral", 0.6), f("Contradiction", 0.9)] == ["Neutral", "Entailment", "Contradiction"]


def test_scores(spark):
    a, b = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    r = one(spark, scores.calibrate(F.lit(0.7), "sigmoid", F.lit(0), F.lit(1)), scores.calibrate(F.lit(0.7), "minmax", F.lit(0.2), F.lit(1.0)), scores.pair_score(a, b), scores.translation_prob(F.lit(2.0)), scores.translation_prob(F.lit(900.0)), scores.text_score(F.lit(0.9), F.lit(0.8), F.lit(0.6)))
    assert [round(x, 6) for x in r] == [0.768525, 0.625, 0.166667, 0.119203, 0.0, 0.64]
    r = one(spark, scores.soft_score(F.lit(0.119203), F.lit(0.64), 0.5), scores.safe_double(F.lit("x")), scores.safe_double(F.lit("NaN")), scores.minmax(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert [round(x, 6) for x in r] == [0.379602, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        scores.calibrate(F.lit(1.0), "other", F.lit(0), F.lit(1))


def test_text(spark):
    r = one(spark, text.norm(F.lit("a b c\x1cd ")), text.claim_form(F.lit("A  claim, here.")), text.jaccard(F.split(F.lit("the drug treats pain"), " "), F.split(F.lit("this drug treats chronic pain well"), " ")), text.jaccard(F.array().cast("array<string>"), F.array(F.lit("a"))))
    assert (r.c0, r.c1, round(r.c2, 6), r.c3) == ("a b c d", "a claim here", 0.428571, 0.0)
    assert list(one(spark, *(text.token_estimate(F.lit(x)) for x in ("", "abcd", "a" * 9)))) == [1, 1, 2]
    assert one(spark, text.ngrams(F.split(F.lit("a b c"), " "), 2)).c0 == ["a", "b", "c", "a b", "b c"]
    assert one(spark, text.ngrams(F.array().cast("array<string>"), 5)).c0 == []
    assert one(spark, text.aliases(F.lit("Gene::AB_C-d"))).c0 == ["gene::ab_c-d", "ab_c-d", "gene::ab c-d", "gene::ab_c d"]
    assert one(spark, text.html_text(F.lit("<p>a<script>x</script> &amp; b</p>"))).c0 == "a & b"
    assert one(spark, text.biomed(F.lit("Aspirin (oral) 50 mg Tablets"))).c0 == "aspirin 50"
    assert one(spark, text.paragraphs(F.lit("  a \t b\n\n\n\nc "))).c0 == "a b\n\nc"


def test_labels(spark):
    f = lambda x, **k: one(spark, text.label_free(F.lit(x), **k)).c0
    assert [f("Label: Entailed."), f("not enough info"), f("gibberish"), f("refutes it")] == ["entailed", "contradicted", None, "contradicted"]
    assert [f("not enough info", strict=True), f("No, it is wrong", strict=True), f("none", strict=True)] == ["neutral", "contradicted", None]
    assert [one(spark, text.label_strict(F.lit(x))).c0 for x in (" Refuted ", "other")] == ["contradicted", None]
    assert [one(spark, text.label_exact(F.lit(x))).c0 for x in ("ENTAILMENT", "Neutral", "x")] == ["entailed", "neutral", None]
