"""Recall and precision on defects planted into clean items: cuts at any character, refusals of other wording than in any table,
answers swapped for those of another language, questions given back, placeholders.

``PLANT_DIR`` names the tables (default sf0.01); ``python tests/llm/test_defects_planted.py`` prints the figures by defect.
"""

import os
import random

from claimlake.llm import defects, queries

DIR = os.environ.get("PLANT_DIR", "/root/testdata/sf0.01")
REFUSE = (
    "I'm afraid I am not permitted to give advice about {w}.", "We cannot offer an opinion on {w}; kindly see your own physician.", "Sorry, we're unable to respond to questions on {w}.", "It is not right for me to recommend anything here.",
    "My rules do not permit me to discuss {w}.", "I would prefer not to comment on that.", "I won't share information about {w}, please contact a clinic.", "Regrettably, I have to decline.", "As a chatbot I can't reply to this.",
)


def plant(rows: list[tuple], share: float, seed: int = 7) -> tuple[list[tuple], dict]:
    """Rows (id, question, answer) with defects in a share of them, and the defect of each."""
    rng = random.Random(seed)
    foreign = [(q, a) for _, q, a in rows if sum(not c.isascii() for c in a) > 0.01 * len(a) and not q.isascii()]
    out, truth = [], {}
    for i, q, a in rows:
        if rng.random() >= share:
            out.append((i, q, a))
            continue
        kind = rng.choice(defects.DEFECTS)
        if kind == "empty":
            a = rng.choice([None, "", "  ", "N/A", "-", "null", "[]", "tbd"])
        elif kind == "copies_question":
            a = rng.choice([q, q.upper(), f"Q: {q}", f"{q} {q}", f"You asked: {q}", q.rstrip("?")])
        elif kind == "refusal":
            a = rng.choice(REFUSE).format(w=rng.choice(q.split()).strip("?,."))
        elif kind == "other_language":
            other = [x for y, x in foreign if y != q]
            if not other or not q.isascii():
                out.append((i, q, a))
                continue
            a = rng.choice(other)
        else:
            at = rng.randrange(len(a) // 3, max(len(a) // 3 + 1, len(a) - 3))
            if len(a) < 60 or a[at - 1 : at + 1].strip() == "" or a[:at].rstrip()[-1:] in ".!?。\n" or a[at : at + 1] in ".!?。\n":
                out.append((i, q, a))
                continue
            a = a[:at]
        truth[i] = kind
        out.append((i, q, a))
    return out, truth


def measure(spark, directory: str, share: float = 0.05) -> dict:
    """By defect (planted, found, found with another label), and the clean items that were found."""
    rows = queries._answers(spark, directory)
    known = {(r.rec_table, r.id) for r in defects.label(rows).select("rec_table", "id").collect()}
    clean = [(f"{r.rec_table}/{r.id}", r.question, r.answer) for r in rows.collect() if (r.rec_table, r.id) not in known and r.question and r.answer]
    planted, truth = plant(sorted(clean), share)
    d = spark.createDataFrame(planted, "id string, question string, answer string").selectExpr("'t' AS rec_table", "id", "question", "answer")
    got = {r.id: r.defect for r in defects.found(d).collect()}
    out = {k: [0, 0, 0] for k in defects.DEFECTS}
    for i, k in truth.items():
        out[k][0] += 1
        out[k][1] += got.get(i) == k
        out[k][2] += got.get(i) not in (None, k)
    out["clean"] = [len(planted) - len(truth), sum(i not in truth for i in got), 0]
    return out


def test_planted_defects(spark):
    m = measure(spark, DIR)
    least = {"empty": 0.99, "copies_question": 0.95, "refusal": 0.8, "other_language": 0.9, "truncated": 0.7}
    assert {k: v for k, v in m.items() if k != "clean" and v[0] and v[1] < least[k] * v[0]} == {}
    assert m["clean"][1] <= 0.01 * m["clean"][0]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    print(measure(s, DIR))
