"""Session-level helpers shared by the operators: checkpoints and partition counts."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster sets it to storage that every executor sees.  Only where it is
    unset (tests, local runs) a temporary folder of this machine is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="claimlake-")
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Unlike a local checkpoint the copy survives the loss of executors.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """Shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Lets the Python workers import this package, wherever the driver was started.

    Workers get the package's folder on their path; on a cluster whose executors may be other machines
    Spark also sends them a copy.
    """
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parent.parent)
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root in paths:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if not sc.master.startswith("local"):
        base = os.path.join(tempfile.mkdtemp(prefix="claimlake-package-"), "claimlake")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "claimlake"))  # from the driver's disk, as Spark sends it


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package on the workers' path."""

    @functools.wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return query(spark, d)

    return run
