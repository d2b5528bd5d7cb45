"""Byte-pair encoding of whole corpora by a lazily determinised transducer (problem 7).

Merge ranks define which two tokens may stand side by side: a token sequence is the encoding
of its bytes exactly if every adjacent pair encodes to itself.  So each prefix of a word has one
last token.  The transducer reads bytes; a nondeterministic item is (token before the open
part, open part), and a deterministic state is a set of items.  States and transitions are made
when first needed and kept.  A transition gives the last token of the prefix read so far.  Tokens are emitted as soon as
all live items agree on them: every item's open part begins at some position, and what all these positions have behind them
cannot change any more.  Open parts are no longer than the longest token, so what is held back is bounded by the
LOOKAHEAD and the stretch on which the items still differ, not by the length of the text.  A word of the public
split pattern once seen is one lookup.

Defined cases: null and empty text give an empty list; text that spells a special token is
ordinary text; any length is encoded whole; repeated rows are encoded alike; other columns of
the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value of the public vocabulary: its split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Bytes that are read before tokens that are sure are looked for.
LOOKAHEAD = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of ``base64 id`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


class Transducer:
    """Words (bytes) to tokens under given ranks."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 2_000_000):
        self.ranks = ranks
        self.most_states = most_states
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t) + 1)}
        self.adjacent: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the states made so far; results do not depend on them."""
        start = ((None, b""),)
        self.items = [start]
        self.known = {start: 0}
        self.moves: list[dict[int, tuple[int, bytes]]] = [{}]
        self.adjacent.clear()

    def merge(self, word: bytes) -> list[bytes]:
        """The encoding by definition: merge the lowest-ranked adjacent pair until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        ok = self.adjacent.get(key)
        if ok is None:
            ok = self.adjacent[key] = self.merge(a + b) == [a, b]
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, bytes]:
        c = bytes((byte,))
        items, last = [], b""
        for before, part in self.items[state]:
            part += c
            if part not in self.prefixes:
                continue
            items.append((before, part))
            if not last and part in self.ranks and (before is None or self.may_follow(before, part)):
                last = part
        items.append((last, b""))
        key = tuple(items)
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.items)
            self.items.append(key)
            self.moves.append({})
        self.moves[state][byte] = (to, last)
        return to, last

    def tokens(self, word: bytes) -> list[int]:
        """Ids of one word."""
        return list(self.stream(word))

    def stream(self, word: bytes) -> Iterator[int]:
        """Ids of one word, each as soon as the bytes that follow cannot change it any more, looked at every LOOKAHEAD bytes."""
        if word in self.ranks and len(word) < 2:
            yield self.ranks[word]
            return
        if len(self.items) > self.most_states or len(self.adjacent) > self.most_states:
            self.reset()
        state, lasts, base = 0, [], 0  # lasts[i - base - 1] is the last token of the first i bytes
        for n, byte in enumerate(word, 1):
            hit = self.moves[state].get(byte)
            state, last = hit if hit is not None else self._move(state, byte)
            lasts.append(last)
            if n - base >= LOOKAHEAD and n % (LOOKAHEAD // 2) == 0:
                # go back from the beginnings of all open parts until they meet
                begins = {n - len(part) for _, part in self.items[state]}
                while len(begins) > 1:
                    at = max(begins)
                    begins.remove(at)
                    begins.add(at - len(lasts[at - base - 1]) if at > base else base)
                sure = begins.pop()
                if sure > base:
                    yield from self._back(lasts, base, sure)
                    del lasts[: sure - base]
                    base = sure
        yield from self._back(lasts, base, len(word))

    def _back(self, lasts: list[bytes], base: int, at: int) -> list[int]:
        """Ids of the bytes from ``base`` to ``at``, read off backwards from the last token."""
        out = []
        while at > base:
            last = lasts[at - base - 1]
            out.append(self.ranks[last])
            at -= len(last)
        out.reverse()
        return out


class _Words(dict):
    """Memo of words; a missing word goes through the transducer."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst = fst

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.fst.tokens(word.encode("utf-8", "surrogatepass")))
        if len(word) <= 64:
            if len(self) > 2_000_000:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.memo = _Words(Transducer(ranks))
        self.split = regex.compile(SPLIT).findall

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.memo.__getitem__, self.split(text)))) if text else 0


_encoders: dict = {}


def _encoder(shared) -> Encoder:
    """One encoder a worker and vocabulary; the worker's later tasks go on with its states."""
    lines = shared.value
    key = hash(lines)
    if key not in _encoders:
        _encoders[key] = Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())})
    return _encoders[key]


def _shared(df: DataFrame, vocabulary: str):
    """The vocabulary file (under a few MB, whatever the data) as a broadcast, so that executors need no path."""
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, ids ARRAY<INT>): one row per input row, no shuffle."""
    shared = _shared(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for whole in batches:
            for o in range(0, whole.num_rows, 1000):
                batch = whole.slice(o, 1000)
                ids, ends = [], [0]
                for t in batch["text"].to_pylist():
                    if t:
                        ids += enc.encode(t)
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["id"], lists], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def with_counts(docs: DataFrame, text_col: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with the token count of each text in place of the text."""
    shared = _shared(docs, vocabulary)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            n = pa.array([enc.count(t) for t in b[text_col].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), n], names=[*rest, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col), f"`{out}` long"])
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns)).mapInArrow(run, schema)


class Utf8Stream:
    """Incremental UTF-8 decoder of token bytes: gives the text that is complete so far.

    A state machine over lead and continuation bytes; an invalid byte gives U+FFFD.
    """

    def __init__(self) -> None:
        self.need, self.value, self.least, self.held = 0, 0, 0, 0

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if 0x80 <= b < 0xC0:
                    self.value = self.value << 6 | b & 0x3F
                    self.need -= 1
                    if not self.need:
                        good = self.value >= self.least and self.value < 0x110000 and not 0xD800 <= self.value < 0xE000
                        out.append(chr(self.value) if good else "�")
                    continue
                out.append("�")
                self.need = 0
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b < 0xE0:
                self.need, self.value, self.least = 1, b & 0x1F, 0x80
            elif 0xE0 <= b < 0xF0:
                self.need, self.value, self.least = 2, b & 0x0F, 0x800
            elif 0xF0 <= b < 0xF5:
                self.need, self.value, self.least = 3, b & 0x07, 0x10000
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What an unfinished sequence gives."""
        out = "�" if self.need else ""
        self.need = 0
        return out


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, text): the texts of id lists, streamed token by token; null ids give null."""
    shared = _shared(rows, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {v: k for k, v in _encoder(shared).memo.fst.ranks.items()}
        for b in batches:
            texts = []
            for ids in b["ids"].to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                s = Utf8Stream()
                texts.append("".join(s.feed(back[i]) for i in ids) + s.end())
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")
