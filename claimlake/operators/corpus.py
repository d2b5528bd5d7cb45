"""Corpus building: row identity, chunking, source caps, page fetching hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.operators.ranking import top_k

SEPARATORS = ("\n\n", "\n", " ", "")


def row_uid(key: str, query: str, response: str) -> Column:
    """Identity of a row across files: its key, else a hash of its content."""
    k = F.trim(F.coalesce(F.col(key), F.lit("")))
    body = F.concat(F.trim(F.coalesce(F.col(query), F.lit(""))), F.lit("\n"), F.trim(F.coalesce(F.col(response), F.lit(""))))
    return F.when(k != "", F.concat(F.lit(f"{key}:"), k)).otherwise(F.concat(F.lit("md5:"), F.md5(body)))


def capped(df: DataFrame, n: int | None = None) -> DataFrame:
    """Row cap of a source: none given means 50, negative means all, zero gives one row."""
    n = 50 if n is None else n
    return df if n < 0 else df.limit(max(1, n))


def split_text(text: str, size: int = 1000, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that occurs and merged with overlap.

    A separator stays at the beginning of the piece that follows it; chunks are stripped, empty ones dropped.
    """
    sep, finer = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text), ("", ()))
    if sep:
        raw = text.split(sep)
        pieces = [raw[0], *(sep + r for r in raw[1:])]
    else:
        pieces = list(text)
    out: list[str] = []
    small: list[str] = []
    for p in pieces:
        if not p:
            continue
        if len(p) < size:
            small.append(p)
            continue
        out += _merge(small, size, overlap)
        small = []
        out += split_text(p, size, overlap, finer) if finer else [p]
    return out + _merge(small, size, overlap)


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    window: list[str] = []
    first = total = 0  # the window is window[first:]
    for p in pieces:
        if total + len(p) > size and len(window) > first:
            joined = "".join(window[first:]).strip()
            if joined:
                out.append(joined)
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(window[first])
                first += 1
        window.append(p)
        total += len(p)
    joined = "".join(window[first:]).strip()
    return [*out, joined] if joined else out


def chunks(docs: DataFrame, key: str, content: str, size: int = 1000, overlap: int = 150) -> DataFrame:
    """``docs`` with a row a chunk: chunk, chunk_index, num_chunks.  Null and blank texts give no row."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: split_text(x, size, overlap))

    d = docs.where(F.col(content).isNotNull()).withColumn("_c", cut(F.col(content)))
    return d.select(*docs.columns, F.size("_c").alias("num_chunks"), F.posexplode("_c").alias("chunk_index", "chunk"))


def fetch(urls: DataFrame, url: str, client: Callable[[], Callable[[str], str | None]], longest: int = 40_000) -> DataFrame:
    """``urls`` with ``page``, from a client made once a task; a failed fetch gives null."""
    out = urls.withColumn("page", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = client()
        for f in frames:
            def one(u: str) -> str | None:
                try:
                    page = get(u)
                except Exception:  # noqa: BLE001 - a page that cannot be had is a null, whatever the reason
                    return None
                return page[:longest] if page else None

            yield f.assign(page=[one(u) for u in f[url]])

    return urls.mapInPandas(run, out.schema)


def fetch_items(rows: DataFrame, item: str, url: str, client: Callable[[], Callable[[str], str | None]], most: int = 5, longest: int = 40_000) -> DataFrame:
    """(item, url, page): the first ``most`` distinct addresses of each item, each address fetched once."""
    kept = top_k(rows.where(F.coalesce(F.col(url), F.lit("")) != "").select(item, url).distinct(), [item], most, F.asc(url)).select(item, url)
    return kept.join(fetch(kept.select(url).distinct(), url, client, longest), url).select(item, url, "page")


def is_pdf(url: Column, content_type: Column | None = None) -> Column:
    """Whether an address is a PDF: by its ending, or by the content type that a server gave for it."""
    by_name = F.lower(url).endswith(".pdf")
    return by_name if content_type is None else F.when(url.isNotNull(), by_name | F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False)))
