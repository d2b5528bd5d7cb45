"""Sinks: JSON Lines, one JSON document, CSV, LaTeX tables, index tables; overwriting unless told to append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of JSON Lines files, UTF-8 and not escaped."""
    df.write.mode("append" if append else "overwrite").json(path)


def document(df: DataFrame, path: str, order: list[str], name: str = "results") -> None:
    """One JSON document {name: [rows in order]}, for results small enough to be one file."""
    rows = df.select(F.struct(*order).alias("_k"), F.struct(*df.columns).alias("_r"))
    one = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.to_json("_r").alias("j")))), lambda x: x["j"]).alias("j"))
    one.select(F.concat(F.lit(f'{{"{name}": ['), F.array_join("j", ", "), F.lit("]}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str) -> None:
    """A summary as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def rows_and_summary(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Rows and their summary side by side, each with its own schema."""
    jsonl(rows, f"{path}/rows")
    jsonl(summary, f"{path}/summary")


def index(chunks: DataFrame, path: str) -> None:
    """One table of vectors, texts and metadata instead of files aligned by position."""
    chunks.write.mode("overwrite").parquet(path)


def by_run(df: DataFrame, path: str, *keys: str) -> None:
    """Partitioned by run keys, so that later reads of one run prune the rest."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def latex(df: DataFrame, columns: list[str], digits: int, caption: str, *order: str) -> str:
    """A LaTeX table of a report-sized frame in order; nulls become --."""
    cells = [F.when(F.col(c).isNull(), "--").otherwise(F.format_string(f"%.{digits}f", F.col(c).cast("double")) if k in ("double", "float") else F.col(c).cast("string")) for c, k in ((c, dict(df.dtypes)[c]) for c in columns)]
    body = [r[0] for r in df.orderBy(*order).select(F.concat_ws(" & ", *cells)).collect()]
    escape = lambda s: s.replace("_", r"\_")
    head = " & ".join(escape(c) for c in columns)
    lines = [r"\begin{table}", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", head + r" \\", r"\midrule", *(escape(b) + r" \\" for b in body), r"\bottomrule", r"\end{tabular}", r"\end{table}"]
    return "\n".join(lines) + "\n"


def report(df: DataFrame, columns: dict[str, str], digits: int, caption: str, label: str, *order: str) -> str:
    """A full-width LaTeX table of a report-sized frame: heads to columns, text and whole numbers as they are, others with
    ``digits``, nulls as --; of the two layouts of run reports each is a choice of columns."""
    kinds = dict(df.dtypes)
    number = {h: kinds[c] in ("double", "float") for h, c in columns.items()}
    show = lambda h, x: "--" if x is None else f"{x:.{digits}f}" if number[h] else str(x)  # noqa: E731 - rounds as the languages of C do
    body = [" & ".join(show(h, r[c]) for h, c in columns.items()) for r in df.orderBy(*order).select(*columns.values()).collect()]
    spec = " ".join("r" if number[h] else "l" for h in columns)
    head = [r"\begin{table*}[t]", r"\centering", r"\small", rf"\begin{{tabular}}{{{spec}}}", r"\toprule", " & ".join(columns) + r" \\", r"\midrule"]
    return "\n".join([*head, *(b + r" \\" for b in body), r"\bottomrule", rf"\caption{{{caption}}}\label{{{label}}}", r"\end{tabular}", r"\end{table*}", ""])


#: Columns of the two reports: of teacher-checked runs, and of graph coverage with the behaviour of the covered subset.
TEACHER_REPORT = {"Dataset": "dataset", "Generator": "generator", "Teacher": "teacher", "F1": "overall_f1", "ClaimRec": "claim_recall", "CtxPrec": "context_precision", "Halluc.": "hallucination", "Faith.": "faithfulness"}
GRAPH_REPORT = {"Dataset": "dataset", "Generator": "generator", "\\#Q": "n_q", "Cov node": "cov_node", "Cov pair": "cov_pair", "Faith. all": "faith_all", "Faith. KG": "faith_kg", "Hall. KG": "hall_kg"}


def report_file(text: str, path: str, append: bool = False) -> None:
    """A report written to a local or mounted file, after what is there with ``append``."""
    with open(path, "a" if append else "w", encoding="utf-8") as f:
        f.write(text)
