"""Queries of the general data-preparation operators: drift and nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimlake.operators import drift, nested


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_t(spark, d, "run_lines"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.table(_t(spark, d, "run_lines"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return drift.values(drift.table(_t(spark, d, "run_lines")))


def p5_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.alternatives(_t(spark, d, "run_lines"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return nested.qa_rows(_t(spark, d, "qa_items"), _t(spark, d, "qa_split_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.elements(_rows(spark, d)).select("rec_table", "id", "path")


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    return nested.tables(_rows(spark, d))


QUERIES = {"p5_found": p5_found, "p5_table": p5_table, "p5_values": p5_values, "p5_alternatives": p5_alternatives, "p6_found": p6_found, "p6_tables": p6_tables}


# Two lines of neighbouring files are one run here if at least half of the fields that both have agree, whatever the values are.
_DRIFT = r"""
r AS (SELECT kind, stream, file_name, written_at, line_no, line FROM run_lines WHERE stream IS NOT NULL AND file_name IS NOT NULL AND json_valid(line) AND json_type(line) = 'OBJECT'),
fo AS (SELECT stream, file_name, row_number() OVER (PARTITION BY stream ORDER BY min(written_at), file_name) AS ord FROM r GROUP BY stream, file_name),
raw AS (SELECT r.kind AS record_kind, r.stream, fo.file_name, fo.ord, r.line_no, x.key AS field, CASE x.type WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind,
  CAST(x.value AS VARCHAR) AS text, x.value AS value FROM r JOIN fo ON fo.stream = r.stream AND fo.file_name = r.file_name, json_each(r.line) AS x),
e AS (SELECT *, CASE kind WHEN 'number' THEN CAST(text AS DOUBLE) WHEN 'string' THEN try_cast(json_extract_string(value, '$') AS DOUBLE)
  WHEN 'array' THEN CASE WHEN json_array_length(value) = 1 THEN try_cast(json_extract_string(value, '$[0]') AS DOUBLE) END
  WHEN 'object' THEN CASE WHEN (json_extract(value, '$.mean') IS NULL) <> (json_extract(value, '$.value') IS NULL) THEN try_cast(coalesce(json_extract_string(value, '$.mean'), json_extract_string(value, '$.value')) AS DOUBLE) END END AS canonical FROM raw),
k AS (SELECT stream, ord, field, list(DISTINCT kind ORDER BY kind) FILTER (WHERE kind IS NOT NULL) AS own FROM e GROUP BY stream, ord, field),
s AS (SELECT stream, ord, field, last_value(own IGNORE NULLS) OVER (PARTITION BY stream, field ORDER BY ord) AS kinds FROM k),
b AS (SELECT coalesce(n.stream, o.stream) AS stream, coalesce(n.ord, o.ord + 1) AS ord, coalesce(n.field, o.field) AS field, n.field IS NOT NULL AS now, o.field IS NOT NULL AS before, n.kinds AS nk, o.kinds AS ok
  FROM s n FULL JOIN s o ON o.stream = n.stream AND o.ord + 1 = n.ord AND o.field = n.field),
c AS (SELECT b.* FROM b JOIN fo ON fo.stream = b.stream AND fo.ord = b.ord WHERE b.ord > 1),
ad AS (SELECT stream, ord, field FROM c WHERE NOT before), rm AS (SELECT stream, ord, field FROM c WHERE NOT now),
v AS (SELECT DISTINCT stream, ord, line_no, field, coalesce(CAST(canonical AS VARCHAR), text) AS value FROM e WHERE kind IS NOT NULL),
st AS (SELECT DISTINCT ad.stream, ad.ord FROM ad JOIN rm ON rm.stream = ad.stream AND rm.ord = ad.ord),
best AS (SELECT x.stream, x.ord, x.line_no AS a, y.line_no AS b FROM v x JOIN st ON st.stream = x.stream AND st.ord = x.ord JOIN v y ON x.stream = y.stream AND x.ord = y.ord + 1 AND x.field = y.field
  GROUP BY 1, 2, 3, 4 HAVING 2 * count(*) FILTER (WHERE x.value = y.value) >= count(*)),
p AS (SELECT best.stream, best.ord, x.field, y.field AS old_field, count(*) AS n, count(*) FILTER (WHERE x.value = y.value) AS eq FROM best
  JOIN v x ON x.stream = best.stream AND x.ord = best.ord AND x.line_no = best.a JOIN ad ON ad.stream = x.stream AND ad.ord = x.ord AND ad.field = x.field
  JOIN v y ON y.stream = best.stream AND y.ord + 1 = best.ord AND y.line_no = best.b JOIN rm ON rm.stream = y.stream AND rm.ord = y.ord + 1 AND rm.field = y.field GROUP BY 1, 2, 3, 4),
q AS (SELECT *, row_number() OVER (PARTITION BY stream, ord, field ORDER BY eq DESC, n, field, old_field) AS r1, row_number() OVER (PARTITION BY stream, ord, old_field ORDER BY eq DESC, n, field, old_field) AS r2 FROM p WHERE eq >= 1 AND eq >= 0.6 * n),
rn AS (SELECT stream, ord, field, old_field FROM q WHERE r1 = 1 AND r2 = 1)
"""

SQL = {
    "p5_found": "WITH " + _DRIFT + r""",
ch AS (SELECT stream, ord, field, '' AS old_field, 'added' AS change FROM ad WHERE (stream, ord, field) NOT IN (SELECT (stream, ord, field) FROM rn)
  UNION ALL SELECT stream, ord, field, '', 'removed' FROM rm WHERE (stream, ord, field) NOT IN (SELECT (stream, ord, old_field) FROM rn)
  UNION ALL SELECT stream, ord, field, '', 'retyped' FROM c WHERE now AND before AND nk IS NOT NULL AND ok IS NOT NULL AND nk <> ok
  UNION ALL SELECT stream, ord, field, old_field, 'renamed' FROM rn)
SELECT fo.file_name, ch.field, ch.old_field, ch.change FROM ch JOIN fo ON fo.stream = ch.stream AND fo.ord = ch.ord
""",
    "p5_values": "WITH RECURSIVE " + _DRIFT + r""",
nm AS (SELECT stream, ord, field, field AS name, ord AS upto, 0 AS depth FROM s
  UNION ALL SELECT nm.stream, nm.ord, nm.field, rn.old_field, rn.ord - 1, depth + 1 FROM nm JOIN rn ON rn.stream = nm.stream AND rn.field = nm.name AND rn.ord <= nm.upto
    WHERE NOT EXISTS (SELECT 1 FROM rn z WHERE z.stream = nm.stream AND z.field = nm.name AND z.ord <= nm.upto AND z.ord > rn.ord)),
nf AS (SELECT stream, ord, field, arg_max(name, depth) AS name FROM nm GROUP BY stream, ord, field)
SELECT e.record_kind AS kind, e.stream, e.file_name, CAST(e.line_no AS BIGINT) AS line_no, nf.name AS field, e.field AS written_as, CASE WHEN kind = 'number' THEN canonical END AS number, CASE WHEN kind = 'string' THEN json_extract_string(value, '$') END AS string,
  CASE WHEN kind = 'boolean' THEN text = 'true' END AS boolean, CASE WHEN kind IN ('array', 'object') THEN text END AS json, e.canonical FROM e JOIN nf ON nf.stream = e.stream AND nf.ord = e.ord AND nf.field = e.field
""",
    "p5_alternatives": "WITH " + _DRIFT.split("raw AS (")[0].rstrip().rstrip(",") + r""",
x AS (SELECT r.stream, r.file_name, fo.ord, regexp_replace(replace(substr(t.fullkey, 3), '"', ''), '\[\d+\]', '[]', 'g') AS path, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind
  FROM r JOIN fo ON fo.stream = r.stream AND fo.file_name = r.file_name, json_tree(r.line) AS t WHERE t.fullkey <> '$' AND t.type <> 'NULL')
SELECT stream, path, kind, arg_min(file_name, ord) AS file_name, count(DISTINCT ord) AS n_files FROM x GROUP BY stream, path, kind
""",
    "p6_found": r"""
WITH m AS (SELECT 'qa_items' AS rec_table, id, 'metadata' AS root, arg_max(metadata, coalesce(epoch_us(loaded_at), 0)) AS raw FROM qa_items WHERE id IS NOT NULL GROUP BY id
  UNION ALL SELECT 'qa_split_items', id, 'source_urls', arg_max(CAST(to_json(source_urls) AS VARCHAR), coalesce(epoch_us(released_at), 0)) FROM qa_split_items WHERE id IS NOT NULL AND source_urls IS NOT NULL GROUP BY id),
u AS (SELECT rec_table, id, root, CASE WHEN NOT json_valid(raw) THEN NULL WHEN json_type(raw) = 'VARCHAR' THEN json_extract_string(raw, '$') ELSE raw END AS j FROM m WHERE raw IS NOT NULL),
v AS (SELECT * FROM u WHERE j IS NOT NULL AND json_valid(j)),
x AS (SELECT v.rec_table, v.id, v.root || substr(x.fullkey, 2) AS path, x.type, CASE WHEN x.type = 'VARCHAR' THEN json_extract_string(v.j, x.fullkey) END AS inner_text, v.root FROM v, json_tree(v.j) AS x WHERE x.type IN ('OBJECT', 'ARRAY', 'VARCHAR')),
i AS (SELECT * FROM x WHERE type = 'VARCHAR' AND (inner_text LIKE '[%' OR inner_text LIKE '{%') AND json_valid(inner_text)),
t AS (SELECT rec_table, id, root, type, path FROM x WHERE type <> 'VARCHAR' UNION ALL SELECT i.rec_table, i.id, i.root, y.type, i.path || substr(y.fullkey, 2) FROM i, json_tree(i.inner_text) AS y WHERE y.type IN ('OBJECT', 'ARRAY')),
g AS (SELECT *, regexp_replace(path, '\[\d+\]', '', 'g') AS generic, path LIKE '%]' AS element FROM t),
a AS (SELECT DISTINCT generic FROM g WHERE type = 'ARRAY' AND NOT element),
lone AS (SELECT rec_table, id, path, length(path) AS n FROM g WHERE type = 'OBJECT' AND NOT element AND path <> root AND generic IN (SELECT generic FROM a)),
o AS (SELECT g.rec_table, g.id, g.path, g.element, list(l.n ORDER BY l.n DESC) FILTER (WHERE l.n IS NOT NULL) AS cuts, bool_or(coalesce(l.path = g.path, FALSE)) AS itself
  FROM g LEFT JOIN lone l ON l.rec_table = g.rec_table AND l.id = g.id AND (g.path = l.path OR starts_with(g.path, l.path || '.') OR starts_with(g.path, l.path || '[')) WHERE g.type = 'OBJECT' GROUP BY g.rec_table, g.id, g.path, g.element),
e AS (SELECT rec_table, id, path AS p0, cuts, coalesce(len(cuts), 0) AS k FROM o WHERE element OR itself)
SELECT rec_table, id, CASE k WHEN 0 THEN p0 ELSE list_reduce(list_prepend(p0, list_transform(cuts, lambda c: CAST(c AS VARCHAR))), lambda s, c: substr(s, 1, CAST(c AS BIGINT)) || '[0]' || substr(s, CAST(c AS BIGINT) + 1)) END AS path FROM e
""",
}
