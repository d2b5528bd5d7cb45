"""Defective pairs: cases of every type, decoys, edge cases, the label model."""

import datetime as dt

from claimlake.llm import defects

T = dt.datetime(2025, 1, 1)
Q = "Is ramipril safe in people with kidney disease?"
FULL = "The dose is reduced in people with kidney disease. A nurse checks the blood pressure after two weeks. The treatment is stopped if the cough does not go away."


def corpus():
    rows = []
    for i in range(150):
        rows.append((f"ok{i}", f"What is the dose of drug{i} in older people?", FULL.replace("dose", f"dose of drug{i}"), T))
    es = "La dosis se reduce en las personas con enfermedad de los riñones. El médico puede recomendar un análisis de la sangre después de unas semanas."
    for i in range(40):
        rows.append((f"es{i}", f"¿Cuál es la dosis de fármaco{i} para las personas mayores?", es, T))
    return rows


CASES = {
    "null": (Q, None, "empty"), "blank": (Q, " ​\n", "empty"), "dash": (Q, "--", "empty"), "na": (Q, "N/A", "empty"), "tag": (Q, "<p></p>", "empty"), "noq": (None, None, "empty"),
    "copy": (Q, Q.upper(), "copies_question"), "twice": (Q, f"{Q} / {Q}", "copies_question"), "label": (Q, f"Q: {Q}", "copies_question"),
    "refuse": (Q, "I'm sorry, but I can't help with that. Please consult a professional.", "refusal"), "refuse2": (Q, "Als KI kann ich diese Frage leider nicht beantworten.", "refusal"),
    "lang": (Q, "La dosis se reduce en las personas con enfermedad de los riñones. El médico puede recomendar un análisis de la sangre.", "other_language"), "zh": (Q, "这种疾病影响肾脏，有时也影响肝脏。请咨询医生后再用药。", "other_language"),
    "cut": (Q, "The dose is reduced in people with kidney disease. A nurse checks the", "truncated"), "comma": (Q, "The dose is reduced in people with kidney disease. If the cough stays,", "truncated"), "paren": (Q, "The dose is reduced in people (among others", "truncated"),
    "no": (Q, "No", None), "yes": (Q, "Yes.", None), "undotted": (Q, "The dose is reduced. A nurse checks the blood pressure after two weeks", None), "sorry": (Q, "I'm sorry you are in pain, but there is good news. " + FULL, None), "repeat": (Q, f"{Q} {FULL}", None), "url": (Q, FULL + " See https://a.example/x", None), "quote": (Q, FULL + ' It is called "the quiet one."', None),
}


# the label model needs a few items of a class to learn from
CUTS = [f"The dose of drug{i} is reduced in people with kidney disease. {x}" for i in range(3) for x in ("A nurse checks the", "The treatment is stopped if the", "A nurse checks the blood pressure after", "The treatment is stopped if")]


def rows(spark, cases):
    return spark.createDataFrame([*corpus(), *((f"cut{i}", Q, a, T) for i, a in enumerate(CUTS)), *((k, q, a, T) for k, (q, a, _) in cases.items())], "id string, question string, answer string, loaded_at timestamp")


def test_cases(spark):
    items = rows(spark, CASES).selectExpr("*", "'x' AS votes", "'y' AS defect")
    got = {r.id: r.defect for r in defects.found(defects.rows_of(items, "t", "answer", "loaded_at")).collect()}
    assert {k: got.get(k) for k in CASES} == {k: w for k, (_, _, w) in CASES.items()}
    assert not [k for k in got if k.startswith(("ok", "es"))]
    assert all(got.get(f"cut{i}") == "truncated" for i in range(len(CUTS)))


def test_latest_delivery_and_null_ids(spark):
    late = T + dt.timedelta(days=1)
    d = spark.createDataFrame([*corpus(), ("a", Q, None, T), ("a", Q, FULL, late), ("b", Q, FULL, T), ("b", Q, "", late), (None, Q, None, T)], "id string, question string, answer string, loaded_at timestamp")
    got = {r.id: r.defect for r in defects.found(defects.rows_of(d, "t", "answer", "loaded_at")).collect()}
    assert got == {"b": "empty"}


def test_empty_and_long(spark):
    d = rows(spark, {"long": (Q, FULL * 3000, None), "cut": (Q, FULL * 300 + " A nurse checks the", "truncated")})
    r = defects.rows_of(d, "t", "answer", "loaded_at")
    got = {x.id: x.defect for x in defects.found(r).collect()}
    assert "long" not in got and got["cut"] == "truncated"
    assert defects.found(r.where("false")).count() == 0


def test_label_model_recovers_classes():
    # three functions of known quality on a rare class
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.05
    votes = np.zeros((20000, 3), int)
    for j, (hit, false, cast) in enumerate(((0.95, 0.01, 0.9), (0.8, 0.05, 0.7), (0.9, 0.02, 0.3))):
        p = np.where(y, hit, false)
        votes[:, j] = np.where(rng.random(20000) < cast, np.where(rng.random(20000) < p, 1, -1), 0)
    patterns: dict = {}
    for v in map(tuple, votes.tolist()):
        patterns[v] = patterns.get(v, 0) + 1
    post = defects.posteriors(defects.learn(patterns), patterns)
    flagged = np.array([post[tuple(v)] > 0.5 for v in votes.tolist()])
    assert (flagged & y).sum() / y.sum() > 0.8 and (flagged & y).sum() / flagged.sum() > 0.8
    assert defects.learn({}) is None and defects.posteriors(None, {}) == {}


DECOYS = {
    "third": (Q, "Patients who are unable to give informed consent need a guardian. " + FULL, None), "stress": (Q, "We can't emphasise enough how helpful rest is. " + FULL, None),
    "regret": (Q, "Sorry about the long wait. " + FULL, None), "nocure": (Q, "Regrettably the cough may stay for some weeks. " + FULL, None),
    "long_refusal": (Q, "I'm sorry, but I am not permitted to respond to that. " + "Please ask your own physician, who knows you, for any advice you need. " * 40, "refusal"),
    "list_end": (Q, FULL + "\n1. rest\n2. water\n3.", "truncated"), "ellipsis": (Q, FULL + " The treatment is stopped if the...", "truncated"), "three": (Q, "Only after the", "truncated"),
}


def test_decoys_and_lengths(spark):
    got = {r.id: r.defect for r in defects.found(defects.rows_of(rows(spark, {**CASES, **DECOYS}), "t", "answer", "loaded_at")).collect()}
    assert {k: got.get(k) for k in DECOYS} == {k: w for k, (_, _, w) in DECOYS.items()}


def test_cutoffs_are_chosen_on_the_other_half(spark):
    report = {r.defect: r for r in defects.cutoff_report(defects.rows_of(rows(spark, CASES), "t", "answer", "loaded_at")).collect()}
    assert set(report) == set(defects.DEFECTS) and all(0 < r.cutoff < 1 for r in report.values())
    # a held-out half without any item keeps the plain cutoff
    assert defects.validated(defects.learn({(1, 1): 3, (-1, -1): 50}), {}, 0.03) == (0.5, 0.0)
    cutoff, f1 = defects.validated(defects.learn({(1, 1): 30, (-1, -1): 500}), {(1, 1): 28, (-1, -1): 510, (0, 0): 5}, 0.03)
    assert cutoff in defects.GRID and f1 > 0.9
