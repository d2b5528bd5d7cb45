"""Keyword-stuffed pages, link lists and tag lists (problem 9).

A text is cut into windows of about WINDOW words.  Each window has features of function-word
share, repetition, surprisal (entropy), link density, boundary density and price density.  For each
language a robust centre and scatter come from all windows of the corpus: medians and median
absolute deviations from fixed histograms, then the covariance of the windows near the centre.
A window whose squared Mahalanobis distance is over the cutoff and whose deviation points
in the spam directions (fewer function words, more repetition, links, boundaries, prices) is
spam; a text is found if such windows hold more than half of its characters.

Shares over few words scatter more: the deviations of a window of fewer than STEADY words are scaled down by the square
root of its part of STEADY, so texts of a few words need no rule of their own.  Chinese is told by its script and read
character by character.  Texts of no known language, and of a language that has fewer than ENOUGH windows, are judged by
the model of all known languages together, and :func:`score` says so; of a known language with too few windows only links,
boundaries and prices count, as its words cannot be compared with those of others.

The cutoff is the 0.997 quantile of chi-squared with 6 degrees of freedom; :func:`validation` measures cutoff and cosine on
spam made from the corpus's own words.

Defined cases: null and empty texts and texts without words are not found; repeated
rows of one id give the id once, with its largest share; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm import textkit
from claimlake.runtime import cut_lineage

WINDOW, STEADY = 20, 13
#: Windows that a language's own model takes.
ENOUGH = 50
#: Windows of a stretch of text, over which words are counted.
STRETCH = 20
CUTOFF, COSINE = 20.0, 0.5
#: Largest deviation that one feature may count for, so that no single one (say a table without function words) decides alone.
MOST = 3.2
FEATURES = ("function", "repeated", "surprisal", "link", "boundary", "price")
#: The first so many features depend on the language.
OF_LANGUAGE = 3
SIGNS = np.array([-1.0, 1.0, -1.0, 1.0, 1.0, 1.0])
FLOOR = np.array([0.06, 0.06, 0.06, 0.2, 0.07, 0.03])
BINS = 512
#: Numbers kept of a window: its features and its number of words.
WIDTH = len(FEATURES) + 1

# Function words by language: fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is was a an by for that with or not as at it are be on from can how why if when who this these they their have has had may should no so than then into above again all also any been before after about but which what there up more most other one some such only just you your we our i my he she his her do does did will would could were out over under between during each both few own same too very once here where while because until without within",
    "es": "el la los las un una unos unas de del y a en es que por para con se no su sus al lo como más pero o si ya muy sin sobre este esta estos entre cuando hasta desde todo durante también fue ha hay antes después qué puede",
    "fr": "le la les un une des de du et à en est que qui par pour avec se ne pas son sa ses au aux ce cette ces comme plus mais ou où si sans sur entre quand dans d l on il elle ils été être peut chez après avant faut a",
    "de": "der die das den dem des ein eine einen einem einer und ist in im zu zum zur mit von vom für auf an am bei nach vor nicht auch sich als wie wer wird werden wurde hat haben kann können oder aber ob durch nur bis aus über unter sollte es warum dass manchmal wieder war nicht bekommen mehr öfter",
    "zh": "的 了 是 在 和 与 或 也 不 有 这 那 为 对 中 于 后 前 请 可 会 能 被 把 而 但 若 及 以 时 更 先 如 果 从 等 将 每 其 所 之 就 都 很 到 由 向 因",
    "pt": "o a os as um uma de do da dos das e em no na nos nas é que por para com se não seu sua ao à como mais mas ou já muito sem sobre este esta entre quando até desde também foi há antes depois pode fale qual já",
}
_state: dict = {}


def _function_table() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For the words' hashes: by their bits from a shift on the place of a function word, the function words' own hashes, and
    for each language whether it has them (place 0 is of no word)."""
    if "words" not in _state:
        sets = [np.unique(textkit.words([text])[0]) for text in FUNCTION_WORDS.values()]
        own = np.unique(np.concatenate(sets))
        shift = next(s for s in range(45) if len(np.unique(own >> np.uint64(s) & _LOW)) == len(own))
        at = np.zeros(int(_LOW) + 1, np.int16)
        at[own >> np.uint64(shift) & _LOW] = np.arange(1, len(own) + 1)
        _state["words"] = at, np.r_[np.uint64(0), own], np.array([np.r_[False, np.isin(own, s)] for s in sets]).astype(np.uint8), shift
    return _state["words"]


_LOW = np.uint64((1 << 20) - 1)
_CJK = regex.compile(r"[\u3400-\u9fff]")
_SPACE, _DOT, _WIDE, _PRICE, _HAN = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    """The class bits of each code point; the last is of all beyond."""
    if "classes" not in _state:
        c = np.zeros(textkit.LIMIT + 1, np.uint8)
        for bit, chars in ((_SPACE, " \t\n\r  　"), (_DOT, ".!?"), (_WIDE, ",;|#•·。，、；\t»>"), (_PRICE, "$€£")):
            c[[ord(x) for x in set(chars)]] |= bit
        c[0x3400:0xA000] |= _HAN
        _state["classes"] = c
    return _state["classes"]


def _read(text: str) -> str:
    """Chinese with a space behind every character, any other text as it is."""
    if text.isascii() or len(_CJK.findall(text)) <= 0.3 * len(text):
        return text
    return _CJK.sub(r"\g<0> ", text)


def _before(x: np.ndarray) -> np.ndarray:
    """The value before each; false before the first."""
    return np.r_[False, x[:-1]] if len(x) else x


def windows(texts: list[str]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """For each lower-cased text its language, the characters of its windows and their features; all texts at once."""
    texts = [_read(t) for t in texts]
    cp, ends_of, begin, end, h = textkit.scan(texts)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    cut = np.searchsorted(begin, np.r_[0, ends_of])  # the first word of each text
    n = np.diff(cut)
    cls = _classes().take(cp, mode="clip")
    space, feed, blank = cls & _SPACE > 0, cp == 10, cp == 32
    after = np.r_[space[1:], True] if len(space) else space
    plain = cls & _WIDE > 0
    plain |= (cls & _DOT > 0) & after
    plain |= (cp == 45) & _before(space) & after
    mark = plain | feed
    bounds = np.flatnonzero(mark & ~_before(mark))  # a row of marks counts once
    # white space noise: where non-breaking or doubled spaces abound, a line feed is a space like others
    plain &= ~feed
    unfed = np.flatnonzero(plain & ~_before(plain))
    odd = np.flatnonzero((cp == 160) | (blank & _before(blank)))
    price, han = np.flatnonzero(cls & _PRICE), np.flatnonzero(cls & _HAN)
    colon = np.flatnonzero((cp[:-2] == 58) & (cp[1:-1] == 47) & (cp[2:] == 47)) if len(cp) > 2 else np.zeros(0, np.int64)
    gap = np.flatnonzero(space)
    at_gap = np.unique(np.searchsorted(gap, colon))
    link_from, link_to = np.r_[-1, gap][at_gap] + 1, gap[at_gap]
    linked = np.r_[0, np.cumsum(link_to - link_from)]  # characters of the links before each
    within = lambda places, lo, hi: np.searchsorted(places, hi) - np.searchsorted(places, lo)

    def in_links(x: np.ndarray) -> np.ndarray:
        """Characters of links before each place."""
        i = np.searchsorted(link_from, x, "right")  # links begun
        over = np.r_[0, link_to][i] - x
        return linked[i] - np.maximum(0, np.where(i > 0, over, 0))

    # languages
    at, own, has, shift = _function_table()
    word = at[h >> np.uint64(shift) & _LOW]
    word[own[word] != h] = 0
    hits = np.zeros((len(FUNCTION_WORDS), len(h) + 1), np.int64)
    for row, k in zip(hits, has):
        np.cumsum(k[word], out=row[1:])
    names = [*FUNCTION_WORDS, "und"]
    share = (hits[:, cut[1:]] - hits[:, cut[:-1]]) / np.maximum(1, n)
    lang = share.argmax(axis=0)
    lang[share.max(axis=0) < 0.08] = len(names) - 1
    lang[within(han, ends_of - length, ends_of) > 0.15 * length] = names.index("zh")  # every second character is a space
    lang[n == 0] = len(names) - 1
    # windows
    k = np.where(n > 0, np.maximum(1, np.rint(n / WINDOW).astype(np.int64)), 0)
    first = np.r_[0, np.cumsum(k)]
    of = np.repeat(np.arange(len(texts)), k)
    place = np.arange(first[-1]) - first[of]
    lo, hi = cut[of] + place * n[of] // k[of], cut[of] + (place + 1) * n[of] // k[of]
    size = hi - lo
    last = place == k[of] - 1
    x0, x1 = begin[lo], np.where(last, ends_of[of], begin[np.where(last, lo, hi)])
    # word frequencies are those of a stretch of the text, so that long texts are judged like short ones
    opens = place % STRETCH == 0
    stretch = np.cumsum(opens) - 1
    extent = np.bincount(stretch, size) if len(size) else np.zeros(0)
    _, name = np.unique(h, return_inverse=True)
    bits, deep = len(h).bit_length(), STRETCH.bit_length()
    key = np.sort(np.repeat((stretch << bits + deep) + place % STRETCH, size) + (name << deep))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)  # a word of a window
    times, key = np.diff(np.r_[new, len(key)]), key[new]
    both = key >> deep
    new = np.r_[True, both[1:] != both[:-1]] if len(key) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    count = np.bincount(group, times)[group] if len(key) else np.zeros(0)
    part = both >> bits
    surprise = np.log2(extent[part] / count) / np.maximum(1.0, np.log2(extent))[part]
    window = np.flatnonzero(opens)[part] + (key & (1 << deep) - 1)
    f = np.empty((len(size), WIDTH), np.float32)
    known = np.minimum(lang[of], len(FUNCTION_WORDS) - 1)
    fw = np.where(lang[of] < len(FUNCTION_WORDS), hits[known, hi] - hits[known, lo], (hits[:, hi] - hits[:, lo]).max(axis=0))
    f[:, 0] = fw / size
    f[:, 1] = 1 - np.bincount(window, minlength=len(size)) / size
    f[:, 2] = np.bincount(window, times * surprise, minlength=len(size)) / size
    chars = np.maximum(1, x1 - x0)
    f[:, 3] = (in_links(x1) - in_links(x0)) / chars
    noisy = within(odd, ends_of - length, ends_of) > 0.03 * n
    f[:, 4] = np.minimum(1.0, np.where(noisy[of], within(unfed, x0, x1), within(bounds, x0, x1)) / size)
    f[:, 5] = np.minimum(1.0, within(price, x0, x1) / size)
    f[:, 6] = np.minimum(size, 1000)
    chars = chars.astype(np.int32)
    return [(names[x], chars[a:b], f[a:b]) for x, a, b in zip(lang, first[:-1], first[1:])]


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, lang, chars, f): the windows of each text as binary arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [t.lower() for t in batch["text"].to_pylist()]
            rows = [w for a, b in textkit.blocks(low) for w in windows(low[a:b])]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([r[0] for r in rows]), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].astype(np.float16).tobytes() for r in rows], pa.binary())], names=["id", "lang", "chars", "f"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, f"id {kind}, lang string, chars binary, f binary")


def _sums(feats: DataFrame, add, cells: int) -> dict[str, np.ndarray]:
    """Sums over all windows by language: ``add(lang, features)`` gives ``cells`` numbers a batch.
    Tasks send one row a language, added up in rounds; the driver gets a few KB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, f in zip(b["lang"].to_pylist(), b["f"].to_pylist()):
                by.setdefault(lang, []).append(f)
            for lang, fs in by.items():
                x = np.frombuffer(b"".join(fs), np.float16).reshape(-1, WIDTH)[:, :-1].astype(np.float64)
                total[lang] = total.get(lang, 0) + add(lang, x)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total)), "v": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    got = textkit.added(feats.select("lang", "f").mapInArrow(run, "lang string, v binary"), "lang", "string", np.float64).collect()  # one row a language
    return {r["lang"]: np.frombuffer(r["v"], np.float64) for r in got}


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit(feats: DataFrame) -> dict[str, Model]:
    """By language: centre, scale and inverse covariance (of scaled deviations) of all windows; "" is of all known languages."""
    k = len(FEATURES)

    def histogram(lang: str, x: np.ndarray) -> np.ndarray:
        at = np.minimum((x.clip(0, 1) * BINS).astype(np.int64), BINS - 1) + np.arange(k) * BINS
        return np.bincount(at.ravel(), minlength=k * BINS).astype(np.float64)

    counts = {lang: v.reshape(k, BINS) for lang, v in _sums(feats, histogram, k * BINS).items()}
    known = [v for lang, v in counts.items() if lang != "und"]
    if known:
        counts[""] = np.sum(known, axis=0)
    centre, scale = {}, {}
    mid = (np.arange(BINS) + 0.5) / BINS
    for lang, h in counts.items():
        med = np.array([mid[np.searchsorted(np.cumsum(r), r.sum() / 2)] for r in h])
        mad = []
        for r, m in zip(h, med):
            order = np.argsort(np.abs(mid - m), kind="stable")
            mad.append(np.abs(mid - m)[order][np.searchsorted(np.cumsum(r[order]), r.sum() / 2)])
        if lang == "" or lang != "und" and h[0].sum() >= ENOUGH:
            centre[lang], scale[lang] = med, np.maximum(1.4826 * np.array(mad), FLOOR)

    def scatter(lang: str, x: np.ndarray) -> np.ndarray:
        """Of the windows near the centre, their number and products: about the language's own centre, and about that of all."""
        out = []
        for name in (lang, ""):
            if name not in centre or lang == "und":
                out.append(np.zeros(1 + k * k))
                continue
            z = (x - centre[name]) / scale[name]
            z = z[(z * z).sum(axis=1) <= 14.45]  # the 0.975 quantile of chi-squared with 6 degrees of freedom
            out.append(np.r_[len(z), (z.T @ z).ravel()])
        return np.concatenate(out)

    sums = _sums(feats, scatter, 2 * (1 + k * k))
    parts = {lang: v[: 1 + k * k] for lang, v in sums.items() if lang in centre}
    if "" in centre:
        parts[""] = sum(v[1 + k * k :] for v in sums.values())
    return {lang: (centre[lang], scale[lang], np.linalg.inv(v[1:].reshape(k, k) / max(1.0, v[0]) + 0.15 * np.eye(k))) for lang, v in parts.items()}


def flags(model: Model, x: np.ndarray, cutoff: float = CUTOFF, cosine: float = COSINE) -> np.ndarray:
    """Which windows (features and number of words) are outliers in the spam directions."""
    d2, toward = _measures(model, x)
    return (d2 > cutoff) & (toward >= cosine)


def _measures(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of each window, and the cosine of its deviation with the spam directions."""
    z = ((x[:, :-1] - model[0]) / model[1]).clip(-MOST, MOST) * np.sqrt(np.minimum(1.0, x[:, -1:] / STEADY))
    d2 = np.einsum("ij,jk,ik->i", z, model[2], z)
    toward = (z * SIGNS).clip(0).sum(axis=1) - 0.5 * (-z * SIGNS).clip(0).sum(axis=1)
    return d2, toward / np.sqrt((z * z).sum(axis=1) + 1e-12)


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF, cosine: float = COSINE) -> DataFrame:
    """(id, spam_share): share of characters in spam windows, for the texts where it is over one half."""
    return score(docs, id_col, text_col, cutoff, cosine).where("spam_share > 0.5")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF, cosine: float = COSINE) -> DataFrame:
    """(id, lang, model, spam_share) of all texts; model is the language that judged it, all where none did of its own."""
    feats = cut_lineage(features(docs, id_col, text_col))
    return _score(feats, fit(feats), cutoff, cosine)


def _seen(model: dict[str, Model], lang: str, x: np.ndarray) -> np.ndarray:
    """Windows as the model that judges them sees them: of a known language without a model of its own only links, boundaries
    and prices count."""
    if lang != "und" and lang not in model:
        x[:, :OF_LANGUAGE] = model[""][0][:OF_LANGUAGE]
    return x


def _score(feats: DataFrame, model: dict[str, Model], cutoff: float, cosine: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share = np.zeros(b.num_rows)
            used = []
            for i, (lang, chars, f) in enumerate(zip(*(b[c].to_pylist() for c in ("lang", "chars", "f")))):
                own = lang if lang in model else ""
                used.append(own or "all")
                m = model.get(own)
                if not chars or m is None:
                    continue
                size = np.frombuffer(chars, np.int32)
                x = _seen(model, lang, np.frombuffer(f, np.float16).reshape(-1, WIDTH).astype(np.float64))
                share[i] = size[flags(m, x, cutoff, cosine)].sum() / size.sum()
            yield pa.RecordBatch.from_arrays([b["id"], b["lang"], pa.array(used, pa.string()), pa.array(share)], names=["id", "lang", "model", "spam_share"])

    kind = feats.schema["id"].dataType.simpleString()
    each = feats.mapInArrow(run, f"id {kind}, lang string, model string, spam_share double")
    return each.groupBy("id").agg(F.max(F.struct("spam_share", "lang", "model")).alias("x")).select("id", "x.lang", "x.model", "x.spam_share")


#: Cutoffs and cosines that are compared, and the characters and long words that spam can be made from.
CUTOFFS, COSINES = (10.0, 15.0, 20.0, 25.0, 30.0), (0.3, 0.5, 0.7)
LEAST_CHARS, LEAST_WORDS = 300, 30
#: Characters of documents whose made texts are read at once: about one block.
AT_ONCE = 50_000
_LONG = re.compile(r"[^\W_]{5,}")
#: Kind of each text of :func:`planted`, and whether it is spam.
KINDS = {"keywords": True, "comma_list": True, "links": True, "tags": True, "mostly": True, "third": False, "clean": False, "lower": False, "unstopped": False}


def planted(text: str, seed: int) -> list[tuple[str, bool, str]]:
    """(kind, is spam, text) made from the words of a text: keywords, links and tags; with a third of it before and after
    an otherwise clean text, which is no spam; the text itself in three writings."""
    words = _LONG.findall(text)
    if len(words) < LEAST_WORDS:
        return []
    n = max(12, len(text) // 18)
    m = max(6, n // 4)
    random = textkit.mix64(np.uint64(seed << 32) + np.arange(6 + 9 * n + 6 * m, dtype=np.uint64)) >> np.uint64(33)
    dice = (random % np.uint64(6)).astype(np.int64)
    thrown = 6 + m

    def draw(count: int) -> np.ndarray:
        nonlocal thrown
        thrown += count
        return dice[thrown - count : thrown]

    pick = [words[i] for i in (random[:6] % np.uint64(len(words))).tolist()]
    low = [w.lower() for w in pick]

    def phrases(n: int, between: str) -> str:
        """Phrases of one to three words."""
        end = (1 + draw(n) % 3).cumsum()
        word = draw(int(end[-1]))
        word[end - 1] += 6
        shown = [w + " " for w in pick] + [w + between for w in pick]
        return "".join([shown[i] for i in word.tolist()])[: -len(between)]

    keywords = phrases(n, " ")
    number = (random[6 : 6 + m] % np.uint64(100_000)).tolist()
    links = "\n".join([f"{p} - https://{low[j]}{i}.example/{x}" for i, (p, j, x) in enumerate(zip(phrases(m, "\n").split("\n"), draw(m).tolist(), number))])
    tag = ["#" + w for w in low]
    tags = " ".join([tag[i] for i in draw(n).tolist()])
    made = [keywords, phrases(n, ", "), links, tags, keywords[: 3 * len(text)] + " " + text[: len(keywords) // 4]]
    made += [text + " " + keywords[: max(80, len(text) // 3)], text, text.lower(), text.replace(". ", " ")]
    return [(kind, spam, t) for (kind, spam), t in zip(KINDS.items(), made)]


def _hits(model: dict[str, Model], texts: list[str]) -> np.ndarray:
    """Of each lower-cased text the cutoffs and cosines at which it is spam, as bits: the first cutoff's cosines first."""
    high, wide = len(CUTOFFS) + 1, len(COSINES) + 1
    out = np.zeros(len(texts), np.int32)
    by: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for a, b in textkit.blocks(texts):
        for i, (lang, chars, f) in enumerate(windows(texts[a:b]), a):
            by.setdefault(lang, []).append((i, chars, f))
    for lang, rows in by.items():
        m = model.get(lang if lang in model else "")
        if m is None:
            continue
        size = np.concatenate([r[1] for r in rows]).astype(np.int64)
        of = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        d2, toward = _measures(m, _seen(model, lang, np.concatenate([r[2] for r in rows]).astype(np.float16).astype(np.float64)))
        # characters by the number of cutoffs and of cosines that a window is beyond
        passed = np.searchsorted(CUTOFFS, d2) * wide + np.searchsorted(COSINES, toward, "right")
        over = np.bincount(of * high * wide + passed, size, len(rows) * high * wide).reshape(-1, high, wide)
        over = over[:, ::-1, ::-1].cumsum(axis=1).cumsum(axis=2)[:, ::-1, ::-1]
        spam = over[:, 1:, 1:].reshape(len(rows), -1) > 0.5 * over[:, :1, 0]
        out[[r[0] for r in rows]] = spam @ (1 << np.arange(spam.shape[1]))
    return out


def validation(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cutoff, cosine, kind, is_spam, n, n_found): how texts of known kind, made from every document, are judged by the models of
    the corpus, for each cutoff and cosine.  Left out are documents that are found themselves and those from which no spam can
    be made, of fewer than LEAST_CHARS characters or LEAST_WORDS long words.

    Texts are made where their document is read; only their bits are shuffled."""
    feats = cut_lineage(features(docs, id_col, text_col))
    model = fit(feats)
    grid = [(c, o) for c in CUTOFFS for o in COSINES]
    lower = list(KINDS).index("lower")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hits = [], [np.zeros((0, len(KINDS)), np.int32)]
            texts, seeds = b["text"].to_pylist(), b["h"].to_pylist()
            for x, y in textkit.blocks(texts, AT_ONCE):
                made = {i: planted(texts[i], seeds[i] & 0xFFFFFFFF) for i in range(x, y)}
                ids += [i for i in made if made[i]]
                # in lower case the text is read as it is; it is not read again
                got = _hits(model, [t.lower() for i in made for kind, _, t in made[i] if kind != "lower"]).reshape(-1, len(KINDS) - 1)
                hits.append(np.insert(got, lower, got[:, list(KINDS).index("clean")], axis=1))
            flat = pa.array(np.concatenate(hits).ravel())
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(ids, pa.int64())), pa.FixedSizeListArray.from_arrays(flat, len(KINDS)).cast(pa.list_(pa.int32()))], names=["id", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{id_col}`").alias("h"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL").where(F.length("text") >= LEAST_CHARS)
    each = rows.mapInArrow(run, f"id {kind}, hits array<int>")
    each = each.join(_score(feats, model, CUTOFF, COSINE).where("spam_share > 0.5").select("id"), "id", "left_anti")
    counts = each.select(F.posexplode("hits").alias("k", "hits")).groupBy("k", "hits").agg(F.count("*").alias("n"))
    of_kind = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("is_spam")) for k, s in KINDS.items()))
    of_grid = F.array(*(F.struct(F.lit(c).alias("cutoff"), F.lit(o).alias("cosine")) for c, o in grid))
    counts = counts.withColumn("x", of_kind[F.col("k")]).select("hits", "n", "x.kind", "x.is_spam", F.posexplode(of_grid).alias("j", "g"))
    hit = F.expr("shiftright(hits, j) & 1")
    return counts.groupBy("g.cutoff", "g.cosine", "kind", "is_spam").agg(F.sum("n").alias("n"), F.sum(F.col("n") * hit).alias("n_found"))
