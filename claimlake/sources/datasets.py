"""Exported question-answer datasets as unified rows.

Hub access is not part of the engine: a dataset is read from an export in Parquet, JSON Lines or one JSON list.
Caps follow ``corpus.capped``: none given means 50 rows, negative all, zero one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.operators import corpus, unify
from claimlake.sources import readers


def raw(spark: SparkSession, path: str) -> DataFrame:
    """(v): each record of an export as a VARIANT."""
    if path.endswith(".parquet"):
        d = spark.read.parquet(path)
        return d.select(F.parse_json(F.to_json(F.struct(*d.columns))).alias("v"))
    return readers.lines(spark, path).where("v IS NOT NULL").select("v")


def abstracts(spark: SparkSession, path: str, subset: str = "pqa_artificial", limit: int | None = -1) -> DataFrame:
    return unify.abstracts(corpus.capped(raw(spark, path), limit), "v", subset)


def pages(spark: SparkSession, path: str, limit: int | None = -1) -> DataFrame:
    return unify.pages(corpus.capped(raw(spark, path), limit), "v")


def live(spark: SparkSession, path: str, limit: int | None = -1, join_all: bool = False) -> DataFrame:
    return unify.live(corpus.capped(raw(spark, path), limit), "v", join_all)


def local_split(spark: SparkSession, path: str, split: str, limit: int | None = None) -> DataFrame:
    """A split that is one JSON list; the position is the id."""
    return unify.local(readers.array_file(spark, path, limit).withColumnRenamed("record", "v"), "v", "pos", split)
