"""Scans of JSON, JSON Lines, TSV, CSV and NPY files, tolerant or strict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Members that may hold a score, in order of preference.
SCORE_KEYS = ("score", "prob", "final_score", "p", "p_final_score")


def jsonl_strict(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON Lines where a broken line is an error; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, v): every line, blank ones too, with its parsed VARIANT or null."""
    d = spark.read.text(path)
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.try_parse_json(F.nullif(F.trim("value"), F.lit(""))).alias("v"))


def line_counters(parsed: DataFrame, key: str = "query_id", score: str = "p_final", others: tuple[str, ...] = SCORE_KEYS) -> DataFrame:
    """Per file n_lines (blank ones count), n_parse_err, n_missing_qid, n_missing_score and the lines by score member used."""
    blank = F.trim("line") == ""
    members = F.coalesce(F.col("v").try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    has = lambda k: F.map_contains_key("_m", k)
    used = F.coalesce(*(F.when(has(k), k) for k in (score, *others)))
    d = parsed.withColumn("_m", members).withColumn("_q", F.try_variant_get("v", f"$.{key}", "string")).withColumn("_u", used)
    ok = ~blank & F.col("v").isNotNull()
    return d.groupBy("file").agg(
        F.count("*").alias("n_lines"), F.count_if(~blank & F.col("v").isNull()).alias("n_parse_err"), F.count_if(ok & F.col("_q").isNull()).alias("n_missing_qid"),
        F.count_if(ok & F.col("_q").isNotNull() & F.col("_u").isNull()).alias("n_missing_score"), *(F.count_if(ok & F.col("_q").isNotNull() & (F.col("_u") == k)).alias(f"used_{k}") for k in (score, *others)),
    )


def scores(parsed: DataFrame, key: str = "query_id", score: str = "p_final", others: tuple[str, ...] = SCORE_KEYS) -> DataFrame:
    """(file, query_id, p_final, node_hit, pair_hit) of parsed score lines; the first score member present counts, flags may be missing."""
    get = lambda k, kind: F.try_variant_get("v", f"$.{k}", kind)
    flag = lambda k: F.coalesce(get(k, "boolean"), get(k, "string").isNotNull() & ~F.coalesce(get(k, "string"), F.lit("")).isin("", "0", "false", "null"), F.lit(False))
    return parsed.where(get(key, "string").isNotNull()).select("file", get(key, "string").alias("query_id"), F.coalesce(*(get(k, "double") for k in (score, *others))).alias("p_final"), flag("node_hit").alias("node_hit"), flag("pair_hit").alias("pair_hit"))


def documents(spark: SparkSession, roots: str | list[str], pattern: str = "*.json", recurse: bool = True, most: int | None = None) -> DataFrame:
    """(file, v): one whole JSON document a file; unreadable files are left out, ``most`` keeps the first files by path."""
    r = spark.read
    d = r.text(roots, wholetext=True, recursiveFileLookup=recurse, pathGlobFilter=pattern)
    d = d.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v")).dropDuplicates(["file"])
    if most is not None:
        d = d.orderBy("file").limit(most)
    return d.where("v IS NOT NULL")


def file_counts(spark: SparkSession, roots: list[str], pattern: str = "*.json") -> DataFrame:
    """(file, readable, n_rows) of the files under several roots, each once whatever roots lead to it; links are resolved
    by the file system; unreadable files are reported and count no rows."""
    d = spark.read.text(sorted(set(roots)), wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    v = F.try_parse_json("value")
    items = F.try_variant_get(v, "$.results", "array<variant>")
    return d.select(F.col("_metadata.file_path").alias("file"), v.isNotNull().alias("readable"), F.coalesce(F.size(items), F.lit(0)).cast("long").alias("n_rows")).dropDuplicates(["file"]).withColumn("n_rows", F.greatest(F.lit(0).cast("long"), "n_rows"))


def results(docs: DataFrame) -> DataFrame:
    """(file, pos, record, metrics) of documents that hold a list under ``results``."""
    items = F.coalesce(F.try_variant_get("v", "$.results", "array<variant>"), F.array().cast("array<variant>"))
    return docs.select("file", F.try_variant_get("v", "$.metrics", "variant").alias("metrics"), F.posexplode(items).alias("pos", "record"))


def rooted(docs: DataFrame) -> DataFrame:
    """(file, pos, record) of documents that are a list, or hold one under ``root``; anything else gives none."""
    items = F.coalesce(F.try_variant_get("v", "$.root", "array<variant>"), F.col("v").try_cast("array<variant>"), F.array().cast("array<variant>"))
    return docs.select("file", F.posexplode(items).alias("pos", "record"))


def array_file(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(pos, record) of a file that is one JSON list; anything else is an error."""
    d = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = F.coalesce(F.col("v").try_cast("array<variant>"), F.raise_error(F.lit("the file is not a JSON list")).cast("array<variant>"))
    out = d.select(F.posexplode(items).alias("pos", "record"))
    return out if most is None else out.orderBy("pos").limit(most)


def preferred_file(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(folder, file): per folder the first file, by name, of the first pattern that matches any.

    ``files`` has a column file; patterns are globs of * on the file name.
    """
    name = F.element_at(F.split("file", "/"), -1)
    rank = None
    for i, p in enumerate(patterns):
        hit = name.rlike("^" + "[^/]*".join(glob_part(x) for x in p.split("*")) + "$")
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    d = files.select("file", F.regexp_replace("file", "/[^/]*$", "").alias("folder"), rank.alias("_r")).where("_r IS NOT NULL")
    return d.groupBy("folder").agg(F.min_by("file", F.struct("_r", "file")).alias("file"))


def glob_part(s: str) -> str:
    """A literal part of a glob as a regular expression."""
    import re

    return re.escape(s)


def tsv(spark: SparkSession, path: str, names: tuple[str, str] = ("raw_id", "idx")) -> DataFrame:
    """Two fixed columns without a header: a name and an integer."""
    return spark.read.csv(path, sep="\t", schema=f"{names[0]} string, {names[1]} long")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one small text file in its order, as the entity readers want it."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as strings."""
    return spark.read.csv(path, header=True)


def labelled(rows: DataFrame, required: list[str], label: str, domain: tuple[str, ...], order: str | None = None, most: int | None = None) -> DataFrame:
    """Rows whose required members are filled and whose label is in the domain; the first ``most`` by ``order``."""
    d = rows
    for c in required:
        d = d.where(F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    d = d.where(F.col(label).isin(*domain))
    return d if most is None else d.orderBy(order or label).limit(most)


def cached_scores(spark: SparkSession, path: str, compute, force: bool = False) -> DataFrame:
    """Scores read from ``path`` if they are there, else computed, written there and read."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if force or not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def hit_sets(scored: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, any_node, any_pair) of scored rows, for reruns that start from stored scores."""
    return scored.groupBy(key).agg(F.bool_or(F.coalesce("node_hit", F.lit(False))).alias("any_node"), F.bool_or(F.coalesce("pair_hit", F.lit(False))).alias("any_pair"))


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        import numpy as np

        n = len(np.load(self.path, mmap_mode="r"))
        return [InputPartition((i, min(i + self.rows, n))) for i in range(0, n, self.rows)] or [InputPartition((0, 0))]

    def read(self, partition):
        import numpy as np

        import pyarrow as pa

        a, b = partition.value
        m = np.load(self.path, mmap_mode="r")
        for i in range(a, b, 4096):
            part = np.ascontiguousarray(m[i : min(b, i + 4096)], dtype=np.float32)
            ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], names=["idx", "vec"])


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``: (idx, vec) of a two-dimensional array file, read in row ranges."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "idx long, vec array<float>"

    def reader(self, schema):
        return _NpyReader(self.options["path"], int(self.options.get("rows", "65536")))


def npy(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").load(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, text, meta, vec) of an index table: texts, metadata and vectors in one, nothing to keep aligned."""
    d = spark.read.parquet(path)
    missing = {"row_id", "text", "meta", "vec"} - set(d.columns)
    if missing:
        raise ValueError(f"not an index table, without {sorted(missing)}")
    return d.select("row_id", "text", "meta", "vec")


def ordered_positions(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` with ``pos`` from 0 within each key."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
