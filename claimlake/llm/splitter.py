"""Cutting oversized texts at natural boundaries, with overlap (problem 4).

Every place in a text has a boundary strength (blank line > line > sentence > clause > comma >
space > none).  A sparse table over the strengths answers range-maximum queries in constant
time: each piece ends at the strongest place of its permissible window, the rightmost of equal
ones, and the next piece begins ``overlap`` code points before that place.

Defined cases: null, empty and texts up to the limit: one piece in :func:`cut`, no row in
:func:`split` (which is for oversized texts only); null arrays and null elements: no row; repeated
rows: a piece set each; a text without any boundary is cut at the limit, never inside a
base character and its combining marks if the window offers another place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
#: Code points of a text that one sparse table covers; longer texts use one after another.
REGION = 1 << 18

_SENTENCE = frozenset(".!?")
_WIDE_SENTENCE = frozenset("。！？")
_CLAUSE = frozenset(";:")
_WIDE_CLAUSE = frozenset("；：")
_WIDE_COMMA = frozenset("，、")
_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """By code point below 0x10000: 1 space, 2 line feed, 3 sentence end, 4 clause end, 5 comma, 6-8 the wide ones, 9 mark that stays with its base."""
    global _kinds
    if _kinds is None:
        k = np.zeros(0x10000 + 1, np.int8)
        for i in range(0x10000):
            c = chr(i)
            if c == "\n":
                k[i] = 2
            elif c.isspace():
                k[i] = 1
            elif 0x300 <= i and (unicodedata.combining(c) or i in (0x200D, 0xFE0F)):
                k[i] = 9
        for chars, v in ((_SENTENCE, 3), (_CLAUSE, 4), (",", 5), (_WIDE_SENTENCE, 6), (_WIDE_CLAUSE, 7), (_WIDE_COMMA, 8)):
            for c in chars:
                k[ord(c)] = v
        _kinds = k
    return _kinds


def strengths(cp: np.ndarray) -> np.ndarray:
    """Strength of the cut before each code point."""
    k = _kind_table().take(np.minimum(cp, 0x10000))
    out = np.zeros(len(cp), np.int64)
    if len(cp) < 2:
        return out
    prev = k[:-1]
    blank = (prev == 1) | (prev == 2)
    s = out[1:]
    s[blank] = 1
    # the last visible kind before the white space that precedes the cut
    place = np.arange(len(cp))
    seen = np.maximum.accumulate(np.where((k != 1) & (k != 2), place, -1))
    before = np.where(seen[:-1] >= 0, k[np.maximum(seen[:-1], 0)], 0)
    s[blank & (before == 5)] = 2
    s[blank & (before == 4)] = 3
    s[blank & (before == 3)] = 4
    s[prev == 8] = 2
    s[prev == 7] = 3
    s[prev == 6] = 4
    feeds = np.cumsum(k == 2)
    at_visible = np.where(seen[:-1] >= 0, feeds[np.maximum(seen[:-1], 0)], 0)
    lines = feeds[:-1] - at_visible
    s[blank & (lines == 1)] = 5
    s[blank & (lines > 1)] = 6
    here = k[1:]
    s[(here == 1) | (here == 2)] = np.minimum(s[(here == 1) | (here == 2)], 0)
    s[here == 9] = -1
    return out


class SparseTable:
    """Range maximum of (strength, position), so the rightmost of equal strengths wins."""

    def __init__(self, values: np.ndarray, longest: int):
        level = (values + 1) * (len(values) + 1) + np.arange(len(values))
        self.size = len(values) + 1
        self.levels = [level]
        step = 1
        while 2 * step <= min(longest, len(values)):
            level = np.maximum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2

    def last_strongest(self, lo: int, hi: int) -> int:
        """Position of the maximum in [lo, hi]."""
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[lo], level[hi + 1 - (1 << k)]) % self.size)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ranges of code points of the pieces."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    least = max(overlap + 1, limit // 2)
    out, start, base, table = [], 0, 0, None
    while n - start > limit:
        if table is None or start + limit >= base + REGION - 1:
            base = max(0, start - 2)
            cp = np.frombuffer(text[base : base + max(REGION, 4 * limit)].encode("utf-32-le", "surrogatepass"), np.uint32)
            table = SparseTable(strengths(cp), limit - least + 1)
        end = base + table.last_strongest(start + least - base, start + limit - base)
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def split(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (rec_table, rec_key, pos, piece, begin, end, text) of the texts over ``limit`` among
    rows (rec_table, rec_key, pos, text).  Only oversized texts leave the JVM; there is no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for o in range(0, whole.num_rows, 500):
                b = whole.slice(o, 500)
                at, piece, begin, end, text = [], [], [], [], []
                for i, t in enumerate(b["text"].to_pylist()):
                    for p, (x, y) in enumerate(cut(t, limit, overlap)):
                        at.append(i)
                        piece.append(p)
                        begin.append(x)
                        end.append(y)
                        text.append(t[x:y])
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(b[c].take(at) for c in ("rec_table", "rec_key", "pos")), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(text, pa.string())],
                    names=["rec_table", "rec_key", "pos", "piece", "begin", "end", "text"],
                )

    rows = texts.select("rec_table", "rec_key", "pos", "text").where(F.char_length("text") > limit)
    return rows.mapInArrow(run, "rec_table string, rec_key string, pos int, piece int, begin long, end long, text string")


def corpus_texts(documents: DataFrame, qa_items: DataFrame) -> DataFrame:
    """(rec_table, rec_key, pos, text) of documents.text and the elements of qa_items.contexts."""
    docs = documents.select(F.lit("documents").alias("rec_table"), F.col("doc_id").cast("string").alias("rec_key"), F.lit(0).alias("pos"), "text")
    ctx = qa_items.select("id", F.posexplode("contexts").alias("pos", "text")).select(F.lit("qa_items").alias("rec_table"), F.col("id").alias("rec_key"), "pos", "text")
    return docs.unionByName(ctx)
