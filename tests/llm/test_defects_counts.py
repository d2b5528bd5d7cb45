"""Counts behind the truncation and language functions: exact whatever else is in the corpus."""

import datetime as dt

import numpy as np

from claimlake.llm import defects, textkit

T = dt.datetime(2025, 1, 1)
Q = "Is ramipril safe in people with kidney disease?"
FULL = "The dose is reduced in people with kidney disease. A nurse checks the blood pressure after two weeks."
PIECE = "nephropa"


def same_cell(word: str, bits: int) -> str:
    """A made-up word whose hash begins with the same bits."""
    top = textkit.words([word])[0][0] >> np.uint64(64 - bits)
    for block in range(80):
        low = [f"zq{block}x{i}" for i in range(100_000)]
        h, _ = textkit.words([" ".join(low)])
        hit = np.flatnonzero(h >> np.uint64(64 - bits) == top)
        if len(hit):
            return low[hit[0]]
    raise AssertionError("no such word")


def labels(spark, other: str) -> set:
    rows = [(f"ok{i}", f"What is the dose of drug{i} in older people?", FULL.replace("dose", f"dose of drug{i}") + (f" It is kept with {other}." if i % 10 == 0 else f" The {other} is kept."), T) for i in range(150)]
    rows += [(f"cut{i}", Q, f"The dose of drug{i} is reduced in people with kidney disease. A nurse checks the", T) for i in range(12)]
    rows += [("piece", Q, f"The dose is reduced in people with kidney disease. The treatment of {PIECE}", T)]
    d = spark.createDataFrame(rows, "id string, question string, answer string, loaded_at timestamp")
    return {(r.id, r.defect, round(r.posterior, 6)) for r in defects.label(defects.rows_of(d, "t", "answer", "loaded_at")).collect()}


def test_words_of_one_hash_prefix_are_not_counted_as_one(spark):
    other = same_cell(PIECE, 20)
    assert other != PIECE
    got = labels(spark, other)
    assert got == labels(spark, "neutral")
    assert ("piece", "truncated") in {x[:2] for x in got}


def test_a_piece_stays_a_piece_however_often_texts_break_off_at_it(spark):
    rows = [(f"ok{i}", f"What is the dose of drug{i} in older people?", FULL.replace("dose", f"dose of drug{i}"), T) for i in range(600)]
    rows += [(f"piece{i}", Q, f"The dose of drug{i} is reduced in people with kidney disease. The treatment of {PIECE}", T) for i in range(260)]
    d = spark.createDataFrame(rows, "id string, question string, answer string, loaded_at timestamp")
    (votes, keys), = defects.votes([Q], [rows[-1][2]], np.zeros(0, np.uint64), np.zeros((len(defects.LANGS), 0)))
    asked = spark.createDataFrame([("t", "x", list(votes), *keys)], "rec_table string, id string, votes array<tinyint>, last bigint, pair bigint, before bigint, whole bigint, hangs boolean, listed boolean")
    got = defects.ends(asked, defects.counts(defects.rows_of(d, "t", "answer", "loaded_at"))).first().votes
    assert dict(zip(defects.FUNCTIONS["truncated"], got[-7:]))["fragment"] == 1


def test_dots_in_a_row_close_nothing(spark):
    low = ["side effects range from mild to... a rash. it helps a lot.", "side effects range from mild to…"]
    h, of, ends, last = defects._scan_texts(low)
    words = [w for t in low for w in __import__("re").findall(r"\w+", t)]
    assert [w for w, e in zip(words, ends) if e] == ["rash", "lot"] and last.sum() == 2
