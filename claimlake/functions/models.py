"""Hooks for model calls: embedding, generation, checking.  The engine ships deterministic stand-ins only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed(df: DataFrame, content: str, model: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "vec", batch: int = 64) -> DataFrame:
    """``df`` with unit vectors of ``content``; the model is made once a task and called in batches.  Distinct texts
    should be embedded once and joined."""

    @F.pandas_udf("array<float>")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = model()
        for s in frames:
            texts = s.fillna("").tolist()
            parts = [call(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            v = np.concatenate(parts) if parts else np.zeros((0, 1))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(v.astype(np.float32)))

    return df.withColumn(out, run(F.col(content)))


def hashing_embedder(size: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A stand-in model: signed counts of hashed words."""
    import zlib

    def make() -> Callable[[list[str]], np.ndarray]:
        def call(texts: list[str]) -> np.ndarray:
            v = np.zeros((len(texts), size))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    v[i, h % size] += 1 if h >> 31 else -1
            return v

        return call

    return make


def generate(df: DataFrame, prompt: str, client: Callable[[], Callable[[str], str]], out: str = "answer", default: str | None = None) -> DataFrame:
    """``df`` with the client's answer to each prompt; a failed call gives ``default`` (neutral for a checker, say)."""
    typed = df.withColumn(out, F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()

        def one(p: str) -> str | None:
            try:
                return call(p)
            except Exception:  # noqa: BLE001 - whatever fails, the row stays
                return default

        for f in frames:
            yield f.assign(**{out: [one(p) for p in f[prompt]]})

    return df.mapInPandas(run, typed.schema)
