"""Defective question-answer pairs by type, through noisy labelling functions (problem 1).

For each defect several labelling functions vote 1 (defective), -1 (not) or 0 (abstain).  The vote
patterns of all items are counted; their number is bounded by the functions, not by the data.
An expectation-maximization label model per defect learns, from the counts of one half of the items (by the hash of
their ids), how far each function can be trusted, and gives each pattern a posterior.  The cutoff of each defect is
validated on the other half, see :func:`validated`.  An item keeps every label whose posterior exceeds the label's
cutoff; :func:`found` keeps the first in DEFECTS order.

Functions for truncation and language rest on exact counts over all texts, keyed by 64-bit hashes: how often
a word, a word pair, or the word after a pair ends a sentence; how often a word occurs; how often a
word occurs in texts that function words place in a language.  Open answers are joined with the counts of their
last words by key; only the words that tell languages apart are broadcast.

Defined cases: a null, blank or placeholder answer is empty whatever the question; a null or blank question can
neither be copied nor set the language; ids delivered several times count once, with the latest
delivery; null ids are left out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.llm import textkit
from claimlake.llm.spam import FUNCTION_WORDS
from claimlake.runtime import cut_lineage

#: In the order in which one label is chosen when several exceed their cutoffs.
DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")
#: Cutoffs to choose from on the held-out half.
GRID = tuple(round(0.3 + 0.05 * i, 2) for i in range(14))
#: Labelling functions of each defect, in the order of their votes.
FUNCTIONS = {
    "empty": ("no_word", "placeholder", "short"),
    "copies_question": ("words_inside", "pairs_inside", "length", "opens_alike"),
    "refusal": ("clause", "speaker", "to_the_asker", "opener", "names_nothing"),
    "other_language": ("function_words", "word_model", "script"),
    "truncated": ("mark", "pair_end", "word_end", "after_pair", "fragment", "function_word", "unfinished"),
}

#: Defects that can only be where a function does not say no: the place of its vote and the share of defects to start from.
GATES = {"truncated": (0, 0.4)}

# What stands for no answer.
PLACEHOLDERS = frozenset("na n/a n.a n.a. none null nan nil tbd todo empty blank unknown missing undefined nothing".split()) | {"no answer", "not available", "no data", "to do", "not provided", "no response", "answer"}

_STRIP = regex.compile(r"<[^<>]*>|&(?:nbsp|#160);?|[\s\p{Z}\p{C}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_LABEL = regex.compile(r"^[\s\W]*(?:q|a|question|answer|you asked|frage|antwort|pregunta|respuesta|réponse|pergunta|resposta)\s*\**\s*[:：]\s*\**", regex.I)
_SENTENCE = regex.compile(r"[^.!?。！？\n]+[.!?。！？\n]*")
# A refusing clause: ability, permission or will denied of an act of speech or help.
_DENIED = (
    r"(?:can(?:no|')t|can not|unable|not able|won't|will not|declin\w*|refus\w*|refrain\w*|(?:'d|would) rather not|prefer not|not (?:be )?(?:allow|permit|authori[sz]|appropriate|right|proper)\w*"
    r"|not have (?:the )?(?:ability|permission|right)|not in a position|against (?:my|our|the)|no\s+(?:answer|advice|information|recommendation|comment)\w*)"
)
_SPEECH = (
    r"(?:answer|assist|help|discuss|respond|comment|recommend|offer)(?:s|ed|ing)?\b|(?:recommendation|response|reply|replies|advice|assistance|information|polic(?:y|ies)|guideline|rule)s?\b"
    r"|(?:provid|shar|advis|giv)(?:e|es|ed|en|ing)\b"
)
_CLAUSE = regex.compile(rf"\b(?:{_DENIED}(?:\W+\w+){{0,4}}?\W+(?:{_SPEECH})|(?:{_SPEECH})(?:\W+\w+){{0,4}}?\W+{_DENIED}|(?:must|have to|will|shall|would|do) (?:declin|refus|refrain)\w*)")
_CLAUSE_ELSEWHERE = regex.compile(
    r"\bno (?:puedo|podemos|me es posible|estoy autorizad\w+)\b|\bme es imposible\b|\bne (?:peux|puis|pouvons) pas\b|\bm'est impossible\b|\bne suis pas (?:en mesure|autorisé)"
    r"|\b(?:kann|darf|möchte) ich (?:\w+ ){0,4}?(?:nicht|keine?)\b|\bich (?:kann|darf|möchte) (?:\w+ ){0,4}?(?:nicht|keine?)\b|\bmir (?:ist es |ist )?(?:nicht möglich|nicht erlaubt)"
    r"|\bnão (?:posso|podemos|me é possível|consigo|tenho permissão)\b|\bimpossível para mim\b|(?:无法|不能|不便)(?:\w{0,4})(?:回答|提供|协助|帮助|给出)"
)
#: Cheap test that must hold where a refusing clause is.
_MAY_DENY = regex.compile(r"can'?n?o?t|unable|not|n't|declin|refus|refrain|against|no |imposs|peux|puis|pouvons|suis pas|kann|darf|möcht|mir |não|无法|不能|不便")
# Pronouns of the two who talk, apologies and requests, by language: what is said to the asker rather than of the matter.
_SELF = regex.compile(r"\b(?:i|i'm|i'd|i've|me|my|we|our|us|this assistant|puedo|podemos|me|mi|je|j'|m'|ich|mir|wir|posso|podemos|mim|consigo|tenho)\b|我")
_ASKER = regex.compile(r"\b(?:i|i'm|i'd|me|my|we|our|you|your|yours|please|su|usted|consulte|acuda|votre|vous|veuillez|ihr\w*|sie|bitte|seu|sua|você|procure|puedo|je|ich|mir|posso)\b|m'est|我|您|你|请")
_OPENER = regex.compile(r"^[\s\W]*(?:as an? \w+|(?:i(?:'m| am) (?:\w+ ){0,2})?sorry|i apologi[sz]e|apologies|unfortunately|regrettably|lo siento|lamento|je suis désolée?|désolée?|es tut mir leid|leider|entschuldig\w*|desculpe|sinto muito|很?抱歉|对不起)\b")
#: A list item, and the mark of one without its item at the end of a list.
_LISTED = regex.compile(r"^\s*(?:[-*•·–]|\d{1,3}[.)])\s+\S")
_BARE_ITEM = regex.compile(r"\S\s*\n[ \t]*(?:[-*•·–]|\d{1,3}[.)])$")
_SEGMENT = regex.compile(r"[.!?。！？;；\n]")
_CJK = regex.compile(r"[\u3400-\u9fff]")
_URL_END = regex.compile(r"https?://\S+$|\bwww\.\S+$")
_CLOSED = frozenset(".!?。！？")
_ELLIPSIS = ("...", "…")
_AFTER_CLOSED = "\"'”’»)]*_  \t\n"
_HANGING = frozenset(",;:，；、([{-–/&+")

#: Languages told by their words; Chinese, which has no spaces, is told by its script.
LANGS = tuple(k for k in FUNCTION_WORDS if k != "zh")
#: The half counts of the word model are dealt over so many words a language.
SMOOTH = 1 << 18
#: Words that the language model holds are at least one in so many of all words, which bounds their number.
RAREST = 1 << 20
#: What is counted: words, word pairs, by the pair before it the word after a pair, and whole sentences of up to three words.
WORD, PAIR, AFTER, WHOLE = 0, 1, 2, 3
COUNTS = ("n", "open_ends", "sure", "sure_end", *(f"lang_{k}" for k in LANGS))
#: Distinct keys that a task holds before it passes its counts on.
HELD = 300_000


#: Stands for every word of digits only.
NUMBER = np.uint64(0x123456789ABCDEF1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return textkit.mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


_fw: dict[str, np.ndarray] = {}


def _function_sets() -> dict[str, np.ndarray]:
    if not _fw:
        for k in LANGS:
            _fw[k] = np.unique(textkit.words([FUNCTION_WORDS[k]])[0])
    return {k: _fw[k] for k in LANGS}


def _all_function_words() -> np.ndarray:
    if "" not in _fw:
        _fw[""] = np.unique(np.concatenate(list(_function_sets().values())))
    return _fw[""]


def _seed_language(hits: np.ndarray, n: int) -> int:
    """Index of the language that the function words give clearly, or -1."""
    order = np.argsort(hits)
    best, second = hits[order[-1]], hits[order[-2]]
    return int(order[-1]) if best >= 3 and best >= 0.15 * n and best >= 2 * second else -1


def _scan_texts(low: list[str]) -> tuple[np.ndarray, ...]:
    """Word hashes, their texts and which words end a sentence, a clause list item or a line inside the text."""
    cp, ends_of, begin, end, h = textkit.scan(low)
    of = np.searchsorted(ends_of, begin)
    stop = np.isin(cp, np.frombuffer(".!?。！？;；\n".encode("utf-32-le"), np.uint32))
    # dots in a row stand for what is left out, they close nothing
    dot = cp == 46
    stop &= ~(dot & (np.r_[False, dot[:-1]] | np.r_[dot[1:], False])) if len(cp) else stop
    # a stop before the next word of the same text, with only marks and spaces between
    sums = np.r_[0, np.cumsum(stop)]
    digit = np.r_[0, np.cumsum((cp >= 48) & (cp < 58))]
    h[digit[end] - digit[begin] == end - begin] = NUMBER  # all numbers are one word
    nxt = np.r_[begin[1:], len(cp)] if len(begin) else begin
    last = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
    upto = np.where(last, ends_of[of] if len(of) else 0, nxt)
    ends = sums[upto] - sums[end] > 0
    return h, of, ends, last


def _short_sentences(h: np.ndarray, of: np.ndarray, ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sentences of up to three words, and which of them are closed."""
    stop = np.flatnonzero(ends | last)
    start = np.r_[0, stop[:-1] + 1]
    size = stop - start + 1
    short = size <= 3
    start, stop, size = start[short], stop[short], size[short]
    out = size.astype(np.uint64)
    for i in range(3):
        out = np.where(size > i, textkit.mix64(out * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(start + i, stop)]), out)
    return out, ends[stop]


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (kind, hash, counts) with the counts of equal keys added up."""
    x = np.concatenate(parts)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    new = np.r_[True, (x[1:, :2] != x[:-1, :2]).any(axis=1)] if len(x) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return np.column_stack([x[at, :2], np.add.reduceat(x[:, 2:], at)]) if len(x) else x


def _counted(kind: int, h: np.ndarray, *masks: np.ndarray | None) -> np.ndarray:
    """Rows (kind, hash, counts): how often each hash occurs under each mask (None counts nothing)."""
    u, inv = np.unique(h, return_inverse=True)
    out = np.zeros((len(u), 2 + len(COUNTS)), np.int64)
    out[:, 0], out[:, 1] = kind, u.view(np.int64)
    for j, m in enumerate(masks):
        if m is not None:
            out[:, 2 + j] = np.bincount(inv[m], minlength=len(u))
    return out


def counts(rows: DataFrame) -> DataFrame:
    """(kind, h, n, open_ends, sure, sure_end, lang_...): exact counts of the words and pairs of all questions and answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        names = ["kind", "h", *COUNTS]
        for batch in batches:
            for column in ("answer", "question"):
                low = [x.lower() for x in batch[column].to_pylist() if x]
                for a, b in textkit.blocks(low, 1_000_000):
                    h, of, ends, last = _scan_texts(low[a:b])
                    if not len(h):
                        continue
                    hits = _function_hits(h, of, b - a)
                    size = np.bincount(of, minlength=b - a)
                    lang = np.array([_seed_language(hits[:, i], size[i]) for i in range(b - a)])[of]
                    by_lang = [lang == k for k in range(len(LANGS))]
                    every = np.ones(len(h), bool)
                    if column == "question":
                        new = [_counted(WORD, h, every, None, None, None, *by_lang)]
                    else:
                        # the last word of a text counts only where a stop follows it: its own end is what is asked
                        sure = ~last | ends
                        p = _pair(h[:-1], h[1:])
                        two = (of[1:] == of[:-1]) & ~ends[:-1] & sure[1:]
                        three = (of[2:] == of[:-2]) & ~ends[:-2] & ~ends[1:-1] & sure[2:]
                        new = [_counted(WORD, h, every, last & ~ends, sure, sure & ends, *by_lang)]
                        new.append(_counted(PAIR, p[two], None, None, np.ones(int(two.sum()), bool), ends[1:][two]))
                        new.append(_counted(AFTER, p[:-1][three], None, None, np.ones(int(three.sum()), bool), ends[2:][three]))
                        whole, closed = _short_sentences(h, of, ends, last)
                        new.append(_counted(WHOLE, whole, np.ones(len(whole), bool), ~closed, None, closed))
                    parts += new
                    held += sum(map(len, new))
                    if held > 2 * HELD:
                        parts = [_summed(parts)]
                        held = len(parts[0])
                        if held > HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0].T], names=names)
                            parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(parts).T], names=names)

    part = rows.select("question", "answer").mapInArrow(run, ", ".join(f"{c} bigint" for c in ("kind", "h", *COUNTS)))
    return part.groupBy("kind", "h").agg(*(F.sum(c).alias(c) for c in COUNTS))


def word_model(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words known by language, and for each the log of how much likelier it is in each language than on average."""
    lang = [f"lang_{k}" for k in LANGS]
    words = counted.where(F.col("kind") == WORD)
    total = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in lang)).first()
    least = max(5, sum(total) // RAREST)  # hence at most RAREST words
    told = words.where(sum((F.col(c) for c in lang), F.lit(0)) >= least).select("h", *lang).toArrow()
    h = told["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    n = np.stack([told[c].to_numpy() for c in lang])[:, order]
    share = (n + 0.5) / (np.array([[total[c]] for c in lang], np.float64) + 0.5 * SMOOTH)
    weight = np.log(share) - np.log(share.mean(axis=0))
    return h[order], weight.clip(-4, 4).astype(np.float16)


def _function_hits(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many function words of each language each of n texts has."""
    if "table" not in _fw:
        every = _all_function_words()
        _fw["table"] = np.stack([np.isin(every, v) for k, v in _function_sets().items()])
    every, table = _fw[""], _fw["table"]
    at = np.minimum(np.searchsorted(every, h), len(every) - 1)
    hit = np.flatnonzero(every[at] == h)
    at, of = at[hit], of[hit]
    return np.stack([np.bincount(of[row[at]], minlength=n) for row in table])


def _languages(low: list[str], known: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float]]:
    """For each text: language by function words or -1, by the word model or -1, and the share of Chinese characters."""
    out: list = []
    for a, b in textkit.blocks(low):
        h, of = textkit.words(low[a:b])
        size = np.bincount(of, minlength=b - a)
        hits = _function_hits(h, of, b - a)
        score = np.zeros((len(LANGS), b - a))
        if len(known) and len(h):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            told = np.flatnonzero(known[at] == h)
            w = weight[:, at[told]].astype(np.float32)
            score = np.stack([np.bincount(of[told], weights=x, minlength=b - a) for x in w])
        s, order = np.sort(score, axis=0), np.sort(hits, axis=0)
        f = np.where((order[-1] >= 2) & (order[-1] > 1.5 * order[-2]), np.argmax(hits, axis=0), -1)
        m = np.where((size >= 3) & (s[-1] - s[-2] > 3), np.argmax(score, axis=0), -1)
        cjk = [0.0 if t.isascii() else len(_CJK.findall(t)) / max(1, len(t)) for t in low[a:b]]
        out += zip(f.tolist(), m.tolist(), cjk)
    return out


def votes(questions: list[str | None], answers: list[str | None], known: np.ndarray, weight: np.ndarray) -> list[tuple[tuple[int, ...], tuple | None]]:
    """Votes of all labelling functions, in the order of FUNCTIONS, for each pair; with the keys of its last words
    for an answer whose end the counts must judge."""
    low_a = [(x or "").lower() for x in answers]
    low_q = [(x or "").lower() for x in questions]
    lang_a, lang_q = _languages(low_a, known, weight), _languages(low_q, known, weight)
    return [_votes_one(q, a, answers[i] or "", la, lq) for i, (q, a, la, lq) in enumerate(zip(low_q, low_a, lang_a, lang_q))]


def _votes_one(q: str, a: str, raw: str, la, lq) -> tuple[tuple[int, ...], tuple | None]:
    bare = _STRIP.sub(" ", a).strip()
    words = _WORD.findall(bare)
    core_text = bare.strip("()[]{}\"'.-–—*_ ")
    placeholder = not words or core_text in PLACEHOLDERS
    empty = (1 if not words else -1, 1 if placeholder else -1, 0 if len(bare) <= 14 else -1)
    if placeholder:
        return ((1, 1, 0) if not words else (0, 1, 0)) + (-1,) * 19, None

    # copies_question
    label = _LABEL.match(a)
    own = _WORD.findall(a, label.end()) if label else words if "<" not in a and "&" not in a else _WORD.findall(a)
    asked = _WORD.findall(q)
    if asked and len(own) >= 2:
        inside = set(asked)
        share = sum(w in inside for w in own) / len(own)
        pairs = set(zip(asked, asked[1:]))
        mine = list(zip(own, own[1:]))
        joined = sum(p in pairs for p in mine) / max(1, len(mine))
        ratio = len(own) / len(asked)
        copies = (1 if share >= 0.97 else -1 if share < 0.9 else 0, 1 if joined >= 0.85 else -1 if joined < 0.6 else 0, 1 if 0.4 <= ratio <= 2.4 else -1, 1 if own[:3] == asked[:3] else 0)
    else:
        copies = (-1, -1, -1, 0)

    refusal = _refusal(a, asked)

    # other_language; Chinese counts as one more language, told by its script
    (f_a, m_a, cjk_a), (f_q, m_q, cjk_q) = la, lq
    if cjk_a > 0.3:
        f_a = m_a = len(LANGS)
    if cjk_q > 0.3:
        f_q = m_q = len(LANGS)
    m_q = m_q if m_q >= 0 else f_q
    if asked:
        language = (0 if f_a < 0 or f_q < 0 else 1 if f_a != f_q else -1, 0 if m_a < 0 or m_q < 0 else 1 if m_a != m_q else -1, 1 if (cjk_a > 0.3) != (cjk_q > 0.3) else -1)
    else:
        language = (0, 0, -1)

    truncated, keys = _truncation(a, raw, words)
    return (*empty, *copies, *refusal, *language, *truncated), keys


def _refusal(a: str, asked: list[str]) -> tuple[int, ...]:
    """Votes on refusal: that a clause denies an act of speech; who its subject is; how much of the answer is said to
    the asker; how it opens; and whether it names more of the question than a refusal does."""
    opener = 1 if _OPENER.search(a) else 0
    sentences = _SENTENCE.findall(a)
    denied = [s for s in sentences if _MAY_DENY.search(s) and (_CLAUSE.search(s) or _CLAUSE_ELSEWHERE.search(s))]
    if not denied:
        return (-1, 0, 0 if opener else -1, opener, 0)
    # a clause whose subject is a third person tells of somebody else
    speaker = 1 if any(_SELF.search(s) for s in denied) else 0
    said = sum(len(s) for s in sentences if s in denied or _ASKER.search(s))
    share = said / max(1, len(a))
    rare = {w for w in asked if len(w) > 4}
    named = sum(w in rare for w in set(_WORD.findall(a)))
    return (1, speaker, 1 if share >= 0.7 else -1 if share < 0.5 else 0, opener, 0 if named <= 2 else -1)


def _truncation(a: str, raw: str, words: list[str]) -> tuple[tuple[int, ...], tuple | None]:
    """Votes on truncation as far as the text alone gives them, and for an open end (last word, last pair, pair before the
    last word, whole sentence if short, is a function word, is a list item), which :func:`ends` judges."""
    text = a.rstrip()
    tail = text.rstrip(_AFTER_CLOSED)
    pairs = (("(", ")"), ("[", "]"), ("“", "”"), ("（", "）"))
    unfinished = any(text.count(x) > text.count(y) for x, y in pairs) or text[-1:] in _HANGING or text.endswith(_ELLIPSIS) or bool(_BARE_ITEM.search(text))
    closed = bool(tail) and tail[-1] in _CLOSED or text[-1:] in "\"”»)" or bool(_URL_END.search(text))
    if unfinished or closed:
        return (1 if unfinished else -1, 0, 0, 0, 0, 0, int(unfinished)), None
    segment = _SEGMENT.split(text)[-1]
    h, of, stops, last = _scan_texts([segment])
    if not len(h) or len(words) == 1:  # an answer of one word has no sentence that could be cut
        return (0,) * 7, None
    hangs = bool(np.isin(h[-1:], _all_function_words())[0])
    signed = lambda x: int(x.view(np.int64)[0])
    pair = signed(_pair(h[-2:-1], h[-1:])) if len(h) > 1 else None
    before = signed(_pair(h[-3:-2], h[-2:-1])) if len(h) > 2 else None
    whole = signed(_short_sentences(h, of, stops, last)[0][-1:].copy()) if len(h) <= 3 else None
    listed = bool(_LISTED.match(text[text.rfind("\n") + 1 :]))
    return (0,) * 7, (signed(h[-1:].copy()), pair, before, whole, hangs, listed)


def ends(open_answers: DataFrame, counted: DataFrame) -> DataFrame:
    """(rec_table, id, votes): the votes of answers with an open end, joined with the counts of their last words."""
    of = lambda kind, key, *cs: counted.where(F.col("kind") == kind).select(F.col("h").alias(key), *(F.col(c).alias(f"{key}_{c}") for c in cs))
    x = open_answers.join(of(WORD, "last", "n", "open_ends", "sure", "sure_end"), "last", "left").join(of(PAIR, "pair", "sure", "sure_end"), "pair", "left").join(of(AFTER, "before", "sure", "sure_end"), "before", "left")
    x = x.join(of(WHOLE, "whole", "sure_end"), "whole", "left")

    def vote(key: str, least: int | Column, low: float, high: float) -> Column:
        r = F.col(f"{key}_sure_end") / F.col(f"{key}_sure")
        return F.when(F.col(f"{key}_sure") >= least, F.when(r < low, 1).when(r > high, -1)).otherwise(0)

    whole = lambda c: F.coalesce(c, F.lit(0))
    x = x.withColumn("common", whole(F.col("last_sure")) >= 20).withColumn("common", F.col("common") & (whole(F.col("last_n")) >= 20))
    x = x.withColumn("pair_end", whole(vote("pair", 5, 0.04, 0.25)))
    # the pair says more than the word alone
    x = x.withColumn("word_end", F.when((F.col("pair_end") == 0) & (F.col("common") | F.col("hangs")), whole(vote("last", F.when(F.col("hangs"), 3).otherwise(20), 0.01, 0.2))).otherwise(0))
    x = x.withColumn("after_pair", F.when(~F.col("common"), whole(vote("before", 5, 0.05, 0.3))).otherwise(0))
    # a piece of a word hardly occurs but where texts break off
    n, broken = whole(F.col("last_n")), whole(F.col("last_open_ends"))
    x = x.withColumn("fragment", F.when(2 * broken >= n, 1).when((n >= 20) & ((F.col("word_end") == -1) | (F.col("pair_end") == -1)), -1).otherwise(0))
    # a function word can end a sentence only where the corpus has it so
    x = x.withColumn("function_word", F.when(F.col("hangs") & (F.col("word_end") != -1) & (F.col("pair_end") != -1), 1).otherwise(0))
    five = ("pair_end", "word_end", "after_pair", "fragment", "function_word")
    # list items need no closing mark, nor short sentences that are closed elsewhere
    item = (F.col("listed") & (F.greatest(*five) < 1)) | (whole(F.col("whole_sure_end")) > 0)
    at = sum(len(v) for d, v in FUNCTIONS.items() if d != "truncated")
    mark = F.when(item, -1).otherwise(F.element_at("votes", at + 1))
    judged = F.array(*(F.when(item, 0).otherwise(F.col(c)).cast("tinyint") for c in five))
    return x.select("rec_table", "id", F.concat(F.slice("votes", 1, at), F.array(mark.cast("tinyint")), judged, F.slice("votes", at + 7, 1)).alias("votes"))


Model = tuple[float, np.ndarray]  # share of defective items; rates of positive votes among cast votes, by class and function


def learn(patterns: dict[tuple[int, ...], int], rounds: int = 60, prior: float = 0.03) -> Model | None:
    """The label model of one defect: two classes with independent functions given the class, fitted by
    expectation-maximization to the pattern counts.  An abstention says nothing about the class; each function's
    rates of positive votes start as more right than wrong."""
    if not patterns:
        return None
    v, n = np.array(list(patterns), int), np.array(list(patterns.values()), float)
    yes, no = (v == 1).astype(float), (v == -1).astype(float)
    start = np.array([0.01, 0.8])
    rate = np.repeat(start[:, None], v.shape[1], axis=1)
    weight = max(5.0, 0.02 * n.sum())
    for _ in range(rounds):
        post = _posterior((prior, rate), v)
        prior = min(0.6, max(5e-3, float((post * n).sum() / n.sum())))
        rate = rate.copy()
        for c, w in ((0, (1 - post) * n), (1, post * n)):
            # the start acts as a few pseudo-observations, so that a rare class cannot drift
            rate[c] = (w @ yes + weight * start[c]) / (w @ yes + w @ no + weight)
        rate[1] = np.maximum(rate[1], rate[0])  # a function may be useless, never misleading
    return prior, rate


def _posterior(model: Model, v: np.ndarray) -> np.ndarray:
    prior, rate = model
    logp = (v == 1).astype(float) @ np.log(rate.T) + (v == -1).astype(float) @ np.log(1 - rate.T)
    return 1 / (1 + np.exp(-(logp[:, 1] - logp[:, 0] + np.log(prior / (1 - prior))).clip(-60, 60)))


def _spoken(model: Model, v: np.ndarray) -> np.ndarray:
    return np.where((v == 1).any(axis=1), _posterior(model, v), 0.0)


def posteriors(model: Model | None, patterns: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """The posterior of each vote pattern; 0 where no function votes for the defect, whatever the prior."""
    return dict(zip(patterns, _spoken(model, np.array(list(patterns), int)).tolist())) if model and patterns else {}


def validated(model: Model | None, held: dict[tuple[int, ...], int], prior: float) -> tuple[float, float]:
    """(cutoff, expected F1) of a fitted model on held-out pattern counts.

    Truth is taken from a second model, fitted to the held-out half alone: an item at the first model's posterior counts as
    defective with the second's probability.  Of the cutoffs with the best expected F1 the middle one is taken; 0.5
    where the held-out half has nothing to tell.
    """
    other = learn(held, prior=prior)
    if model is None or other is None:
        return 0.5, 0.0
    v, n = np.array(list(held), int), np.array(list(held.values()), float)
    p, q = _spoken(model, v), _spoken(other, v)
    f1 = [2 * (n * q)[p > c].sum() / max(1e-9, n[p > c].sum() + (n * q).sum()) for c in GRID]
    best = [c for c, f in zip(GRID, f1) if f >= max(f1) - 1e-6]
    return best[len(best) // 2], float(max(f1))


def rows_of(items: DataFrame, table: str, answer_col: str, time_col: str, id_col: str = "id", question_col: str = "question") -> DataFrame:
    """(rec_table, id, question, answer), the latest delivery of each id."""
    rows = items.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("string").alias("id"), F.struct(F.col(f"`{time_col}`").alias("t"), F.col(f"`{question_col}`").alias("question"), F.col(f"`{answer_col}`").alias("answer")).alias("x"))
    return rows.groupBy("id").agg(F.max("x").alias("x")).select(F.lit(table).alias("rec_table"), "id", "x.question", "x.answer")


def voted(rows: DataFrame) -> DataFrame:
    """(rec_table, id, half, defect, part): the votes of the functions of each defect on each item; ``half`` by the id's hash."""
    rows = cut_lineage(rows)
    counted = cut_lineage(counts(rows))
    shared = rows.sparkSession.sparkContext.broadcast(word_model(counted))  # at most RAREST words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        for whole in batches:
            for o in range(0, whole.num_rows, 1000):
                b = whole.slice(o, 1000)
                v = votes(b["question"].to_pylist(), b["answer"].to_pylist(), known, weight)
                keys = [k or (None,) * 6 for _, k in v]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
                flat = pa.array(np.array([x for x, _ in v], np.int8).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * (len(flat) // max(1, len(v)))), flat)
                yield pa.RecordBatch.from_arrays([b["rec_table"], b["id"], lists, *(pa.array([k[j] for k in keys], t) for j, t in enumerate(kinds))], names=["rec_table", "id", "votes", "last", "pair", "before", "whole", "hangs", "listed"])

    first = cut_lineage(rows.mapInArrow(run, "rec_table string, id string, votes array<tinyint>, last bigint, pair bigint, before bigint, whole bigint, hangs boolean, listed boolean"))
    both = first.where("last IS NULL").select("rec_table", "id", "votes").unionByName(ends(first.where("last IS NOT NULL"), counted))
    each, at = [], 0
    for d, names in FUNCTIONS.items():
        each.append(F.struct(F.lit(d).alias("defect"), F.slice("votes", at + 1, len(names)).alias("part")))
        at += len(names)
    half = F.xxhash64("id").bitwiseAND(1).cast("int")
    return cut_lineage(both.select("rec_table", "id", half.alias("half"), F.explode(F.array(*each)).alias("e")).select("rec_table", "id", "half", "e.defect", "e.part"))


def models(votes_of: DataFrame) -> dict[str, tuple[Model | None, float, float, dict[tuple[int, ...], int]]]:
    """For each defect the model fitted to one half, its validated cutoff, its expected F1 there, and all pattern counts.
    What comes to the driver is at most two rows a defect and pattern of its own votes: 3^7 for the largest."""
    by: dict[str, tuple[dict, dict]] = {d: ({}, {}) for d in DEFECTS}
    for r in votes_of.groupBy("defect", "half", "part").count().collect():
        gate, _ = GATES.get(r["defect"], (None, 0))
        if gate is None or r["part"][gate] != -1:
            by[r["defect"]][r["half"]][tuple(r["part"])] = r["count"]
    out = {}
    for d, (fit, held) in by.items():
        _, prior = GATES.get(d, (None, 0.03))
        every = {k: fit.get(k, 0) + held.get(k, 0) for k in {**fit, **held}}
        model = learn(fit or held, prior=prior)
        out[d] = (model, *validated(model, held, prior), every)
    return out


def label(rows: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(rec_table, id, defect, posterior): every label over its cutoff; ``cutoffs`` overrides the validated ones."""
    each = voted(rows)
    post: list[tuple] = []
    for d, (model, cutoff, _, every) in models(each).items():
        limit = (cutoffs or {}).get(d, cutoff)
        post += [(d, list(k), p) for k, p in posteriors(model, every).items() if p > limit]
    if not post:
        return each.select("rec_table", "id", "defect", F.lit(0.0).alias("posterior")).where("false")
    known = F.broadcast(rows.sparkSession.createDataFrame(post, "defect string, part array<tinyint>, posterior double"))  # at most 3^7 rows a defect
    return each.join(known, ["defect", "part"]).select("rec_table", "id", "defect", "posterior")


def cutoff_report(rows: DataFrame) -> DataFrame:
    """(defect, cutoff, expected_f1, prior, functions): what the label models learnt; functions as
    name:rate among the sound:rate among the defective."""
    out = []
    for d, (model, cutoff, f1, _) in models(voted(rows)).items():
        rates = "" if model is None else " ".join(f"{name}:{a:.3f}:{b:.3f}" for name, a, b in zip(FUNCTIONS[d], *model[1]))
        out.append((d, cutoff, round(f1, 6), None if model is None else round(model[0], 6), rates))
    return rows.sparkSession.createDataFrame(out, "defect string, cutoff double, expected_f1 double, prior double, functions string")


def found(rows: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(rec_table, id, defect): one row a defective item, its first label in DEFECTS order."""
    rank = F.array_position(F.array(*(F.lit(d) for d in DEFECTS)), F.col("defect"))
    return label(rows, cutoffs).groupBy("rec_table", "id").agg(F.min_by("defect", rank).alias("defect"))
