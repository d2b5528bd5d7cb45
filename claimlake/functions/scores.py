"""Column functions on scores and probabilities (all inside the JVM)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(c: Column, default: float | None = 0.0) -> Column:
    """As a double; null, NaN and unreadable values give the default."""
    d = c.try_cast("double")
    d = F.when(~F.isnan(d), d)
    return d if default is None else F.coalesce(d, F.lit(default))


def round_binary(c: Column, digits: int) -> Column:
    """Rounded as printf does: by the exact binary value, ties to even.  Spark's round goes by the shortest decimal, half
    up, and differs at 0.25 or 0.35; no built-in sees the binary value, so batches of Arrow do it."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(v, digits), na_action="ignore")

    return run(c.cast("double"))


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def logit(c: Column, eps: float = 1e-6) -> Column:
    p = clamp(c, eps, 1 - eps)
    return F.ln(p / (1 - p))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def minmax(c: Column, lo: Column, hi: Column) -> Column:
    """Position between lo and hi in [0, 1]; 0 for a range of up to 1e-12 or unknown bounds."""
    return F.when(lo.isNull() | hi.isNull() | (hi - lo <= 1e-12), 0.0).otherwise(clamp((c - lo) / (hi - lo)))


def calibrate(c: Column, method: str, lo: Column, hi: Column) -> Column:
    """A score under calibration none, minmax or sigmoid (steepness 6 about one half)."""
    if method == "minmax":
        return minmax(c, lo, hi)
    if method == "sigmoid":
        return sigmoid(6 * (c - 0.5))
    if method == "none":
        return c
    raise ValueError(f"unknown calibration {method!r}")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def pair_score(a: Column, b: Column) -> Column:
    """Closeness of two entity vectors in (0, 1]."""
    return 1 / (1 + distance(a, b))


def translation_distance(h: Column, r: Column, t: Column) -> Column:
    """Length of head + relation - tail."""
    moved = F.zip_with(F.zip_with(h, r, lambda x, y: x.cast("double") + y.cast("double")), t, lambda x, y: x - y.cast("double"))
    return F.sqrt(F.aggregate(moved, F.lit(0.0), lambda s, x: s + x * x))


def translation_prob(dist: Column) -> Column:
    """1 / (1 + e^dist); 0 where the power overflows."""
    return 1 / (1 + F.exp(dist))


def text_score(head: Column, tail: Column, relation: Column) -> Column:
    return F.least(head, tail) * (0.5 + 0.5 * relation)


def soft_score(kge: Column, text: Column, alpha: float) -> Column:
    """Mixture of embedding and text evidence; text alone where there is no embedding score."""
    return F.when(kge.isNull(), text).otherwise((1 - alpha) * kge + alpha * text)


def argmax_enc(e: Column, n: Column, c: Column) -> Column:
    """Most likely label; ties go to entailed, then neutral, then contradicted."""
    return F.when((e >= n) & (e >= c), "entailed").when((n >= e) & (n >= c), "neutral").otherwise("contradicted")


def argmax_ecn(e: Column, c: Column, n: Column) -> Column:
    """Most likely label; ties go to entailed, then contradicted, then neutral."""
    return F.when((e >= c) & (e >= n), "entailed").when((c >= e) & (c >= n), "contradicted").otherwise("neutral")


def fuse_logit(e: Column, n: Column, c: Column, score: Column, beta: float = 0.8, eps: float = 1e-6) -> Column:
    """STRUCT(e, n, c): entailment mixed with a graph score in logit space.

    The three probabilities are first made to sum to 1 (thirds if all are 0); the mass left of the mixed
    entailment is shared in the ratio of the other two (halves if both are 0).
    """
    total = e + n + c
    third = F.lit(1.0 / 3.0)
    pe, pn, pc = (F.when(total > 1e-12, x / total).otherwise(third) for x in (e, n, c))
    mixed = sigmoid(beta * logit(pe, eps) + (1 - beta) * logit(score, eps))
    rest = pn + pc
    share = F.when(rest > 1e-12, pn / rest).otherwise(0.5)
    return F.struct(mixed.alias("e"), ((1 - mixed) * share).alias("n"), ((1 - mixed) * (1 - share)).alias("c"))


def fuse_additive(e: Column, c: Column, n: Column, score: Column, alpha: float = 0.8, tau: float = 0.3) -> Column:
    """STRUCT(e, c, n): entailment raised by what the score has over tau, then normalised."""
    up = F.least(F.lit(1.0), e + alpha * F.greatest(F.lit(0.0), score - tau))
    c, n = F.greatest(F.lit(0.0), c), F.greatest(F.lit(0.0), n)
    total = up + c + n + 1e-9
    return F.struct((up / total).alias("e"), (c / total).alias("c"), (n / total).alias("n"))


def fuse_label(label: Column, score: Column, low: float = 0.25, high: float = 0.55) -> Column:
    """Labels corrected by score thresholds: weak entailment to neutral, strongly scored neutral to entailment."""
    return F.when((label == "Entailment") & (score < low), "Neutral").when((label == "Neutral") & (score > high), "Entailment").otherwise(label)
