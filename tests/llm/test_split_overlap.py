"""Split overlap against brute force, with edge cases and hot groups."""

import random
import re
import unicodedata

from claimlake.llm import split_overlap, textkit

W = re.compile(r"[^\W_]+")


def words(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    return frozenset(W.findall(t))


def brute(rows, least=0.8):
    tr = [(i, words(q)) for i, s, q in rows if q and s and s.strip().lower() == "train" and words(q)]
    ev = [(i, words(q)) for i, s, q in rows if q and s and s.strip().lower() in split_overlap.EVALUATION and words(q)]
    return {(min(a, b), max(a, b)) for a, x in tr for b, y in ev if a != b and len(x & y) >= least * len(x | y) - 1e-9}


def frame(spark, rows):
    return spark.createDataFrame([(i, s, q, "d", "z", 1) for i, s, q in rows], "id string, split string, question string, dataset string, node string, side int")


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    common = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(400):
        n = rng.choice([1, 2, 3, 4, 5, 6, 8, 11, 12, 13, 15, 20, 40, 60])
        base = [rng.choice(common) if rng.random() < 0.7 else f"r{rng.randrange(3000)}" for _ in range(n)]
        rows.append((f"t{i}", rng.choice(["train", "TRAIN ", "Train"]), " ".join(base)))
        for k in range(2):
            e = list(base)
            for _ in range(rng.randrange(0, max(1, n // 4) + 1)):
                j = rng.randrange(len(e))
                op = rng.random()
                if op < 0.4 and len(e) > 1:
                    e.pop(j)
                elif op < 0.8:
                    e.insert(j, f"n{rng.randrange(999)}")
                else:
                    e[j] = rng.choice(common)
            rng.shuffle(e)
            rows.append((f"e{i}{k}", rng.choice(["val", "dev", "test", "Validation", "TEST "]), " ".join(e)))
    want = brute(rows)
    got = {tuple(r) for r in split_overlap.pairs(frame(spark, rows)).collect()}
    assert len(want) > 200 and got == want


def test_edges(spark):
    rows = [("a", "train", None), ("b", "val", None), ("c", None, "same words here now"), ("d", "train", "Same WORDS, hére now!"), ("e", "dev", "same words here now"), ("e", "dev", "same words here now"), ("f", "holdout", "same words here now"), ("g", "train", "?!"), ("h", "test", "..."), ("x", "train", "x"), ("y", "test", "X"), ("l", "train", "word " * 5000 + " ".join(f"u{i}" for i in range(3000))), ("m", "val", " ".join(f"u{i}" for i in range(2900)))]
    assert {tuple(r) for r in split_overlap.pairs(frame(spark, rows)).collect()} == brute(rows) == {("d", "e"), ("x", "y"), ("l", "m")}
    assert split_overlap.pairs(frame(spark, rows).where("false")).count() == 0
    r = {(x.split, x.dataset): (x.n_items, x.n_overlapping, x.n_pairs) for x in split_overlap.report(frame(spark, rows)).collect()}
    assert r == {("val", "d"): (2, 1, 1), ("dev", "d"): (1, 1, 1), ("test", "d"): (2, 1, 1)}


def test_hot_copies(spark):
    rows = [(f"t{i}", "train", "one question asked by everyone") for i in range(60)] + [(f"e{i}", "val", "one question asked by everyone" + (" today" if i % 2 else "")) for i in range(20)]
    assert {tuple(r) for r in split_overlap.pairs(frame(spark, rows)).collect()} == brute(rows)


def test_hot_keys_become_work_items(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = np.zeros(300, split_overlap.ENTRY)
    rows["node"], rows["n"], rows["side"], rows["pos"] = np.arange(300), rng.integers(20, 40, 300), np.arange(300) < 100, rng.integers(0, 9, 300)
    rows["sketch"] = rng.integers(0, 1 << 7, 300)
    want = {(min(int(a["node"]), int(b["node"])), max(int(a["node"]), int(b["node"]))) for a in rows[:100] for b in rows[100:] if split_overlap._may_match(np.array([a]), np.array([b]), 0.8)[0]}
    for hot, side in ((1 << 24, 4096), (5000, 32)):
        monkeypatch.setattr(split_overlap, "HOT", hot)
        monkeypatch.setattr(split_overlap, "SIDE", side)
        items = [r for b in split_overlap._reduce(rows, 0.8) for r in b.to_pylist()]
        assert any(r["crossed"] for r in items) == (hot == 5000)
        d = spark.createDataFrame([(bytearray(r["a"]), bytearray(r["b"]), r["crossed"]) for r in items], "a binary, b binary, crossed boolean")
        assert {tuple(r) for r in split_overlap._expand(d, 0.8).collect()} == want


def test_banded_is_symmetric_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    left, right = np.repeat(np.arange(80), 80), np.tile(np.arange(80), 80)
    got = split_overlap.banded(sets, left, right, 0.6)
    for a, b, j in zip(left, right, got):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        want = len(x & y) / len(x | y)
        assert abs(j - want) < 1e-12 if want >= 0.6 else j == 0 or abs(j - want) < 1e-12


def test_words_match_pattern():
    for t in ("", "a_b c", "Élan vital", "x١٢ ß ﬁ", "İstanbul", "中文 test", "a\x00b"):
        assert len(textkit.words([t.lower()])[0]) == len(W.findall(t.lower()))
