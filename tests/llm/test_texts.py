"""Splitting, encoding, mixing and spam: properties, round trips, brute force."""

import random
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlake.llm import bpe, mixing, spam, splitter

HARD = ["", " ", "don't we'll 'tis it''s", "a\n\n  b \t c   ", "café 中文 \U0001f600", "<|endoftext|>", "x" * 300, "1234567 ½", " 　 nbsp", "a\x00b", "́x", "tabs\t\tend  "]
needs_vocabulary = pytest.mark.skipif(not Path(bpe.VOCABULARY).exists(), reason="no public vocabulary on this machine")


def check_pieces(t, limit, overlap):
    p = splitter.cut(t, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(t)
    assert all(0 <= b - a <= limit for a, b in p)
    assert all(y[0] == x[1] - overlap for x, y in zip(p, p[1:]))
    assert len(p) == 1 or len(t) > limit
    return p


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n,;。́", max_size=400), st.integers(10, 60))
def test_pieces(t, limit):
    check_pieces(t, limit, limit // 5)


def test_cuts_at_the_strongest_rightmost_place():
    t = "a" * 1200 + ". " + "b" * 300 + "\n\n" + "c" * 300 + ". " + "d" * 1000
    assert splitter.cut(t)[0] == (0, 1504)
    t = "a" * 1200 + ". " + "b" * 100 + ". " + "c" * 2000
    assert splitter.cut(t)[0] == (0, 1304)
    assert splitter.cut("x" * 4100) == [(0, 2000), (1800, 3800), (3600, 4100)]
    assert splitter.cut("x" * 2000) == [(0, 2000)]
    check_pieces("word " * 300_000, 2000, 200)  # several index regions
    with pytest.raises(ValueError):
        splitter.cut("x" * 10, 5, 5)


def test_sparse_table():
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.integers(-1, 5, 500)
    table = splitter.SparseTable(v, 100)
    for _ in range(300):
        lo = int(rng.integers(0, 400))
        hi = lo + int(rng.integers(0, 99))
        best = max(range(lo, hi + 1), key=lambda i: (v[i], i))
        assert table.last_strongest(lo, hi) == best


def test_split_rows(spark):
    d = spark.createDataFrame([(1, "x" * 2001, "t"), (2, None, "t"), (3, "short", "t"), (1, "x" * 2001, "t")], "doc_id long, text string, piece string")
    q = spark.createDataFrame([("a", ["s", "y " * 1500, None]), ("b", None), (None, ["z" * 2500])], "id string, contexts array<string>")
    got = splitter.split(splitter.corpus_texts(d, q)).where("piece = 1").select("rec_table", "rec_key", "pos").distinct().collect()
    assert {tuple(r) for r in got} == {("documents", "1", 0), ("qa_items", "a", 1), ("qa_items", None, 0)}
    assert splitter.split(splitter.corpus_texts(d.where("false"), q.where("false"))).count() == 0


@needs_vocabulary
def test_same_ids_as_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    ref = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.Encoder(ranks)
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice("abcde 'sté中\n.1 ") for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        assert enc.encode(t) == ref.encode_ordinary(t)
        assert enc.count(t) == len(ref.encode_ordinary(t))
    enc.memo.fst.most_states = 10  # forgetting states changes nothing
    enc.memo.clear()
    assert [enc.encode(t) for t in texts] == [ref.encode_ordinary(t) for t in texts]


@needs_vocabulary
def test_encode_and_decode(spark):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(HARD)] + [(99, None, 1), (0, "", 1)], "doc_id int, text string, ids int")
    e = bpe.encode(d)
    got = {r.doc_id: r.ids for r in e.collect()}
    assert got[99] == [] and got[0] == [] and e.count() == len(HARD) + 2
    back = {r.doc_id: r.text for r in bpe.decode(e).collect()}
    assert all(back[i] == t for i, t in enumerate(HARD)) and back[99] == ""
    assert bpe.encode(d.where("false")).count() == 0


@given(st.binary(max_size=30), st.integers(1, 5))
@settings(suppress_health_check=list(HealthCheck), deadline=None)
def test_utf8_stream_on_valid_text(data, step):
    t = data.decode("latin-1") + "€\U0001f600"
    raw = t.encode()
    s = bpe.Utf8Stream()
    assert "".join(s.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + s.end() == t
    bad = bpe.Utf8Stream()
    assert "�" in bad.feed(b"\xff") and bad.feed(b"\xe2\x82") == "" and bad.end() == "�"


@needs_vocabulary
def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, "word " * rng.randrange(5, 60), "big" if i % 10 else "small") for i in range(600)] + [(1000, None, "big"), (1001, "", "small"), (1002, "x y", None), (5, "word " * 9, "big")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("m", "big", 0.5, 2, 0.6), ("m", "small", 0.5, 3, 0.6), ("cap", "small", 1.0, 2, 1.0), ("cap", "absent", 0.1, 1, 1.0), ("n", "big", None, None, 1.0)], "mix_name string, source string, target_share double, max_repeats int, size_ratio double")
    drawn, report = mixing.mix(d, t)
    rows = drawn.collect()
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    cap = {("m", "big"): 2, ("m", "small"): 3, ("cap", "small"): 2}
    assert all(0 < r.copies <= cap[r.mix_name, r.source] for r in rows)
    rep = {(r.mix_name, r.source): r for r in report.collect()}
    assert rep["m", "big"].mix_tokens == pytest.approx(rep["m", "big"].wanted_tokens, abs=61)
    assert rep["m", "small"].most_copies == 3 and rep["m", "small"].mix_tokens < rep["m", "small"].wanted_tokens  # its cap is short of the share
    assert rep["cap", "small"].most_copies == 2 and rep["cap", "absent"].mix_tokens == 0 and rep["n", "big"].mix_tokens == 0
    assert sorted(map(tuple, mixing.mix(d, t)[0].collect())) == sorted(map(tuple, rows))
    assert mixing.mix(d.where("false"), t)[0].count() == 0
    assert rep["m", "small"].bound and not rep["m", "big"].bound and abs(rep["m", "big"].deviation) < 0.02
    # the number of documents is fixed, whatever the seed
    assert len({mixing.mix(d, t, seed=s)[0].where("mix_name = 'm' AND source = 'big'").groupBy().sum("copies").first()[0] for s in (1, 2)}) == 1


def test_missing_size_goes_to_the_others():
    assert mixing.wanted([(0.5, 10.0), (0.3, 100.0), (0.2, 100.0)], 60.0, False) == [(10.0, True), (18.0, False), (12.0, False)]
    assert mixing.wanted([(0.5, 10.0), (0.3, 100.0), (0.2, 100.0)], 60.0, True) == [(10.0, True), (30.0, False), (20.0, False)]
    assert mixing.wanted([(0.5, 10.0), (0.3, 25.0), (0.2, 100.0)], 60.0, True) == [(10.0, True), (25.0, True), (25.0, False)]
    assert mixing.wanted([(1.0, 5.0)], 60.0, True) == [(5.0, True)] and mixing.wanted([(0.0, 5.0)], 60.0, True) == [(0.0, False)]


def test_odds_with_certain_documents(spark):
    # one document is larger than the rest together: it is certain, the odds of the others give what is left
    sizes = spark.createDataFrame([(0, "s", 1000), *((i, "s", 10) for i in range(1, 101))], "doc_id long, source string, n_tokens long")
    planned = spark.createDataFrame([("m", "s", 1500.0)], "mix_name string, source string, rest double")
    scale = mixing.odds(sizes, planned, 1.0).first().scale
    assert scale * 1000 > 1 and sum(min(1.0, scale * n) * n for n in [1000] + [10] * 100) == pytest.approx(1500.0)


def prose(rng, n=12):
    """Sentences with the function words of English and content words of a large vocabulary."""
    def w():
        return "".join(rng.choice("bdfklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4)))

    return " ".join(f"The {w()} of the {w()} is {w()} and it may {w()} in a {w()} that has no {w()} for {w()}." for _ in range(n))


def test_spam(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng)) for i in range(300)]
    kw = " ".join(rng.choice(["buy pillox", "pillox cheap", "pillox online", "best pillox"]) for _ in range(120))
    links = "\n".join(f"Shop{i} deals - https://shop{i}.example/{i * 7}" for i in range(60))
    tags = " ".join(f"#pillox{i % 9} #buy{i % 7}" for i in range(60))
    bad = {1000: kw, 1001: links, 1002: tags, 1003: prose(rng, 3) + " " + kw, 1004: ", ".join(kw.split(" "))}
    good = {2000: prose(rng) + " " + kw[:300], 2001: prose(rng).lower().replace(".", ""), 2002: "short one", 2003: prose(rng).replace(". ", " (see https://a.example/p1). ", 4), 2004: None, 2005: "", 2006: prose(rng).replace(" ", "  \n")}
    d = spark.createDataFrame([*rows, *bad.items(), *good.items(), (1000, kw)], "doc_id long, text string").withColumn("f", F.lit(1)).withColumn("lang", F.lit("xx"))
    got = sorted(r.id for r in spam.found(d).collect())
    assert got == sorted(bad)
    assert spam.found(d.where("false")).count() == 0
    long = spark.createDataFrame([*rows, (9000, prose(rng, 1500)), (8000, (kw + " ") * 40)], "doc_id long, text string")
    assert [r.id for r in spam.found(long).where("id IN (8000, 9000)").collect()] == [8000]


def test_tokens_come_out_before_the_text_ends():
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    fst = bpe.Transducer(ranks)
    word = ("abcdefghij" * 5000).encode()
    read = []

    class Counting(bytes):
        def __iter__(self):
            for b in super().__iter__():
                read.append(b)
                yield b

    it = fst.stream(Counting(word))
    next(it)
    assert len(read) <= 2 * bpe.LOOKAHEAD  # the first token is out long before the end
    assert fst.tokens(word) == [ranks[t] for t in _merged(fst, word[:2000])] + fst.tokens(word)[len(_merged(fst, word[:2000])) :]
    for text in (b"x" * 3000, bytes(range(256)) * 20, "äöü汉字".encode() * 300, b"ababab" * 700):
        assert fst.tokens(text) == [ranks[t] for t in fst.merge(text)]


def _merged(fst, word):
    """The encoding of a prefix without its last tokens, which what follows may change."""
    return fst.merge(word)[:-20]


def test_short_texts_other_languages_and_chinese(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng)) for i in range(300)]
    zh = "这种疾病影响肾脏，有时也影响肝脏。如果发热超过十二天，请咨询专科医生。使用药物治疗从每天九毫克开始，夜间复查。"
    extra = {1000: "None", 1001: "See above", 1002: "N/A", 1003: ".", 1004: "https://a.example/x", 2000: zh * 3, 2001: "买药 便宜药 " * 40, 3000: "kaunis talo seisoo maella ja valo loistaa ikkunasta ulos pihalle illalla " * 3}
    d = spark.createDataFrame([*rows, *extra.items()], "doc_id long, text string")
    got = {r.id: r for r in spam.score(d).where("id >= 1000").collect()}
    assert not [i for i in (1000, 1001, 1002, 1003, 2000) if got[i].spam_share > 0.5]
    assert got[2000].lang == "zh" and got[2000].model == "all" and got[3000].model == "all"


def test_planted_kinds(spark):
    rng = random.Random(9)
    d = spark.createDataFrame([(i, prose(rng, 14)) for i in range(400)], "doc_id long, text string")
    v = [r for r in spam.validation(d).collect() if (r.cutoff, r.cosine) == (spam.CUTOFF, spam.COSINE)]
    for is_spam in (True, False):
        n, hit = (sum(getattr(r, c) for r in v if r.is_spam == is_spam) for c in ("n", "n_found"))
        assert n > 0 and (hit / n > 0.95 if is_spam else hit / n < 0.05)
    assert spam.planted("too short", 1) == []


def test_every_document_is_validated(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 18)) for i in range(2100)] + [(i, "cheap pills " * 200) for i in range(5000, 5003)]
    rows += [(5000, prose(rng, 18)), (None, prose(rng, 18)), (6000, None), (6001, "too short")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = spam.validation(d).collect()
    assert {r.n for r in got} == {2100} and len(got) == len(spam.CUTOFFS) * len(spam.COSINES) * len(spam.KINDS)
    assert spam.validation(d.where("false")).count() == 0
    # words are drawn from the whole text
    assert "later" in spam.planted("first " * 400 + "later " * 4000, 3)[0][2]


def test_validation_judges_as_the_score_does(spark):
    import numpy as np

    rng = random.Random(13)
    spanish = " ".join(["El médico explica que la paciente tiene fiebre alta y que no se debe esperar más para tomar un remedio suave en la noche."] * 4)
    docs = {i: prose(rng, rng.randrange(18, 30)) for i in range(120)} | {900: spanish}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    model = spam.fit(spam.features(d, "doc_id", "text"))
    assert "es" not in model and spam.windows([spanish.lower()])[0][0] == "es"
    made = [(i, kind, t) for i, h in d.select("doc_id", F.xxhash64("doc_id")).collect() for kind, _, t in spam.planted(docs[i], h & 0xFFFFFFFF)]
    want = dict.fromkeys(spam.KINDS, 0)
    for _, kind, t in made:
        lang, chars, f = spam.windows([t.lower()])[0]
        x = spam._seen(model, lang, f.astype(np.float16).astype(float))
        want[kind] += bool(chars[spam.flags(model.get(lang, model[""]), x)].sum() > 0.5 * chars.sum())
    got = {r.kind: (r.n, r.n_found) for r in spam.validation(d).collect() if (r.cutoff, r.cosine) == (spam.CUTOFF, spam.COSINE)}
    assert got == {k: (121, n) for k, n in want.items()} and want["keywords"] > 100


def test_windows_are_of_the_text_alone():
    rng = random.Random(14)
    texts = ["", "a", "http://x"] + ["".join(rng.choice("ab the of la 中文的 \n\t,.;-://  $#\u00a0\u3000é\U0001f600") for _ in range(rng.randrange(900))) for _ in range(200)]
    for t, (lang, chars, f) in zip(texts, spam.windows(texts)):
        own = spam.windows([t])[0]
        assert lang == own[0] and chars.tolist() == own[1].tolist() and f.tolist() == own[2].tolist()
