"""Run metadata from path and file-name conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _part(c: Column, sep: str, i: int) -> Column:
    return F.try_element_at(F.split(c, sep), F.lit(i))


def run_columns(path: Column) -> list[Column]:
    """dataset, teacher, generator of the nearest eval_... folder (else of the third one up), and split and generator of the folder above the last."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    evals = F.filter(folders, lambda x: x.startswith("eval_"))
    root = F.coalesce(F.try_element_at(evals, F.lit(-1)), F.try_element_at(folders, F.lit(-3)))
    name = F.substring(root, F.lit(6), F.length(root))
    parts = F.split(name, "-")
    run = F.try_element_at(folders, F.lit(-2))
    return [
        parts[0].alias("dataset"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("unknown")).alias("teacher"),
        F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 3, F.size(parts)), "-")).otherwise("unknown").alias("generator"),
        _part(run, r"\.", 1).alias("dataset_split"), F.coalesce(F.when(run.contains("."), _part(run, r"\.", 2)), F.lit("unknown")).alias("run_generator"),
    ]


def file_columns(name: Column) -> list[Column]:
    """model, method, whether a file is fused already, and its stem without repeated fusion tags."""
    base = F.try_element_at(F.split(name, "/"), F.lit(-1))
    # fixed values: the naming pattern of the files
    method = F.regexp_extract(base, "__checker_(sft|grpo)_", 1)
    rest = F.regexp_extract(base, "__checker_(?:sft|grpo)_([^_]+(?:_[^_]+)*)", 1)
    stem = F.regexp_replace(F.regexp_replace(base, r"\.jsonl?$", ""), "(?:__kgfused)+$", "")
    return [
        F.coalesce(F.nullif(F.split(rest, "__kg")[0], F.lit("")), F.lit("unknown")).alias("model"), F.coalesce(F.nullif(method, F.lit("")), F.lit("unknown")).alias("method"),
        base.contains("__kgfused").alias("is_fused"), stem.alias("stem"),
    ]


def cleanup(files: DataFrame, tag: str = "__kgfused") -> DataFrame:
    """(file, action, target) of output files: names with a repeated tag are to be renamed to the tag once, or deleted where
    the name they would get is taken; the rest is kept.  Nothing is touched: the table is the dry run."""
    d = files.select("file", F.regexp_replace("file", f"(?:{tag})+(\\.[a-z]+)$", f"{tag}$1").alias("target")).distinct()
    own = F.col("file") == F.col("target")
    first = F.row_number().over(Window.partitionBy("target").orderBy(F.when(own, 0).otherwise(1), "file"))
    return d.select("file", F.when(own, "keep").when(first == 1, "rename").otherwise("delete").alias("action"), "target")
