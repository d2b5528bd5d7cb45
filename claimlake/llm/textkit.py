"""Vectorised words and word-sequence hashes of whole batches of texts.

A word is a run of letters or digits of the lower-cased text.  A block of texts is
one array of code points; word borders come from a class table, word hashes from
prefix sums of a polynomial, so no Python work is done per word or character.
All hashes are 64 bits and depend only on the text, never on the batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points at or above this are never letters or digits (checked against Unicode 16).
LIMIT = 0x33480
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))


def _make_tables() -> tuple[np.ndarray, np.ndarray]:
    alnum = np.zeros(LIMIT + 1, dtype=bool)
    alnum[:LIMIT] = np.fromiter((chr(i).isalnum() for i in range(LIMIT)), bool, LIMIT)
    return alnum, mix64(np.arange(1, LIMIT + 2, dtype=_U))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_state: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if "alnum" not in _state:
        _state["alnum"], _state["mix"] = _make_tables()
    return _state["alnum"], _state["mix"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _state.get("pow")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 19)
        up, down = np.full(size, _BASE, _U), np.full(size, _INV, _U)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 1 << 22:
            _state["pow"] = have
    return have


def blocks(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters; one longer text is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def scan(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the joined texts, the place of each text's closing line feed, and of the words
    of the (already lower-cased) texts begin, end and hash."""
    alnum, mix = _tables()
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends_of = np.cumsum(lengths) - 1
    cp = np.minimum(raw, LIMIT)
    w = alnum.take(cp)
    w[ends_of] = False
    edge = np.flatnonzero(w[1:] != w[:-1]) + 1
    if len(w) and w[0]:
        edge = np.r_[0, edge]
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers(len(cp))
    sums = np.zeros(len(cp) + 1, _U)
    np.cumsum(mix.take(cp) * up[: len(cp)], out=sums[1:])
    return raw, ends_of, begin, end, mix64((sums[end] - sums[begin]) * down[begin])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the (already lower-cased) texts in order, and the text that each word is of."""
    _, ends_of, begin, _, h = scan(texts)
    return h, np.searchsorted(ends_of, begin).astype(np.int64)


def shingles(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``k``-word sequences (empty below ``k`` words)."""
    h, of = words(texts)
    n = len(h) - k + 1
    if n <= 0:
        return [np.zeros(0, _U)] * len(texts)
    acc = np.zeros(n, _U)
    for i in range(k):
        acc = acc * _U(0xD6E8FEB86659FD93) + h[i : i + n]
    good = of[:n] == of[k - 1 :]
    acc, of = mix64(acc[good]), of[:n][good]
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    return [np.unique(acc[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def word_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its words."""
    h, of = words(texts)
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def set_hash(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set of hashes; equal sets have equal ones."""
    a = int(np.add.reduce(mix64(values), dtype=_U)) if len(values) else 0
    b = int(np.bitwise_xor.reduce(mix64(values ^ _U(0xA5A5A5A5DEADBEEF)))) if len(values) else 0
    return _signed(a), _signed(b ^ len(values))


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """The first hash of :func:`set_hash` of many sets at once; 0 for an empty one."""
    out = np.zeros(len(sets), np.int64)
    full = np.flatnonzero(np.fromiter(map(len, sets), np.int64, len(sets)))
    if len(full):
        at = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        out[full] = np.add.reduceat(mix64(np.concatenate([sets[i] for i in full])), at).view(np.int64)
    return out


def added(parts: DataFrame, key: str, key_type: str, dtype, rounds: int = 64) -> DataFrame:
    """(key, v): tables of fixed size, sent by tasks as binary arrays (key, v), added up element by element.

    Two rounds: of each key, the arrays of tasks with the same number modulo ``rounds`` first, then the at most ``rounds``
    sums; so the last task of a key gets few arrays however many tasks there were, and both rounds hold one array.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for k, v in zip(b[key].to_pylist(), b["v"].to_pylist()):
                if total is not None and k != at:
                    yield pa.RecordBatch.from_pydict({key: pa.array([at], b[key].type), "v": pa.array([total.tobytes()], pa.binary())})
                    total = None
                at, kind = k, b[key].type
                x = np.frombuffer(v, dtype)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({key: pa.array([at], kind), "v": pa.array([total.tobytes()], pa.binary())})

    schema = f"{key} {key_type}, v binary"
    once = lambda d, *by: d.repartition(*by).sortWithinPartitions(*by).select(key, "v").mapInArrow(merge, schema)
    return once(once(parts.withColumn("_r", F.spark_partition_id() % rounds), "_r", key), key)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
