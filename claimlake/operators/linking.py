"""Entity tables, surface dictionaries and linking of texts to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions import text

# Header and column names under which entity tables and name maps come.
HEADERS = ("entity_name", "entity", "name", "entity_id", "id")
SURFACE_COLUMNS = ("surface_form", "surface", "mention", "alias", "name", "text")
NAME_COLUMNS = ("drkg_entity", "entity_name", "entity", "drkg_entity_name")
ID_COLUMNS = ("entity_id", "drkg_id", "drkg_entity_id", "id")


def entity_lines(lines: DataFrame, line: str, line_no: str, header: tuple[str, ...] = HEADERS, ambiguous: str = "row") -> DataFrame:
    """(name, eid) of two-column lines in either order, with or without a header row.

    The column of digits is the id.  Where neither or both are digits, ``ambiguous`` gives a counter of the
    rows read so far (row), or leaves the line out (drop).  Of a repeated name the last line counts.
    """
    cols = F.split(F.col(line), "\t")
    a, b = text.strip(F.try_element_at(cols, F.lit(1))), text.strip(F.try_element_at(cols, F.lit(2)))
    d = lines.where(text.strip(line) != "").select(line_no, a.alias("a"), b.alias("b"), cols.alias("c"))
    first = d.agg(F.min(line_no).alias("_f"))
    d = d.crossJoin(F.broadcast(first))  # one row
    is_header = (F.col(line_no) == F.col("_f")) & F.exists("c", lambda x: F.lower(x).isin(*header))
    d = d.where(~is_header & (F.size("c") >= 2))
    digits = lambda x: F.col(x).rlike("^[0-9]+$")
    clear = digits("a") != digits("b")
    if ambiguous == "drop":
        d = d.where(clear)
        counter = F.lit(None).cast("long")
    else:
        d = _counted(d, line_no, "_n")
        counter = F.col("_n")
    name = F.when(clear & digits("a"), F.col("b")).otherwise(F.col("a"))
    eid = F.when(clear & digits("a"), F.col("a").try_cast("long")).when(clear, F.col("b").try_cast("long")).otherwise(counter)
    return d.select(line_no, name.alias("name"), eid.alias("eid")).groupBy("name").agg(F.max_by("eid", line_no).alias("eid"))


#: Lines that are ranked together when a file's rows are counted.
RANGE = 1 << 16


def _counted(d: DataFrame, line_no: str, name: str) -> DataFrame:
    """``d`` with the number of its rows on earlier lines: within ranges of line numbers, plus the rows of earlier ranges,
    whose table has one row a range."""
    part = F.floor(F.col(line_no) / RANGE).alias("_part")
    sizes = d.groupBy(part).agg(F.count("*").alias("_c"))
    before = sizes.select("_part", (F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(line_no)) - 1
    return d.withColumn("_part", part).join(before, "_part").withColumn(name, (own + F.col("_before")).cast("long")).drop("_part", "_before")


def pick(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    return next((c for c in wanted if c in columns), None)


def resolve_names(names: DataFrame, entities: DataFrame, order: Column, rules: tuple[str, ...] = ("id", "entity", "second"), surface: str | None = None, id_columns: tuple[str, ...] = ID_COLUMNS) -> DataFrame:
    """(surface, eid): a name table of unknown column names against entities (name, eid).

    ``rules`` say in which order a row is resolved: by digits in an id column (id), by that column as an entity
    name (raw), by an entity-name column (entity), by the second column (second).  Of a repeated surface the last resolved
    row counts.
    """
    cols = names.columns
    s = surface or pick(cols, SURFACE_COLUMNS) or cols[0]
    by_id, by_name = pick([c for c in cols if c != s], id_columns), pick([c for c in cols if c != s], NAME_COLUMNS)
    d = names.select(order.alias("_o"), text.surface(s).alias("surface"), *(F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(cols)))
    d = d.where("surface IS NOT NULL AND surface <> '' AND surface <> 'nan'")
    at = lambda c: f"_{cols.index(c)}"
    choice = {"id": at(by_id) if by_id else None, "raw": at(by_id) if by_id else None, "entity": at(by_name) if by_name else None, "second": at(cols[1]) if not by_name and len(cols) > 1 else None}
    found = []
    for r in rules:
        c = choice.get(r)
        if c is None:
            continue
        if r == "id":
            d = d.withColumn(f"r_{r}", F.when(text.strip(c).rlike("^[0-9]+$"), text.strip(c).try_cast("long")))
        else:
            e = entities.select(F.col("name").alias(f"n_{r}"), F.col("eid").alias(f"r_{r}"))
            d = d.join(e, text.strip(c) == F.col(f"n_{r}"), "left")
        found.append(F.col(f"r_{r}"))
    if not found:
        return d.select("surface", F.lit(None).cast("long").alias("eid")).where("false")
    return d.select("surface", "_o", F.coalesce(*found).alias("eid")).where("eid IS NOT NULL").groupBy("surface").agg(F.max_by("eid", F.struct("_o", "eid")).alias("eid"))


def alias_table(entities: DataFrame, name: str, eid: str) -> DataFrame:
    """(surface, eid) of generated aliases; the entity with the smallest id keeps a shared one."""
    e = entities.where(F.col(name).isNotNull()).select(F.col(eid).alias("eid"), F.explode(text.aliases(name)).alias("surface"))
    return e.groupBy("surface").agg(F.min("eid").alias("eid"))


def merge(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(surface, eid) of both dictionaries; the primary one wins."""
    u = primary.select("surface", "eid", F.lit(0).alias("p")).unionByName(fallback.select("surface", "eid", F.lit(1).alias("p")))
    return u.groupBy("surface").agg(F.min_by("eid", F.struct("p", "eid")).alias("eid"))


def mentions(texts: DataFrame, key: str, content: str, surfaces: DataFrame, longest: int = 5) -> DataFrame:
    """(key, eid) distinct: entities whose surface is a run of 1 to ``longest`` tokens of the text."""
    grams = texts.select(key, F.explode(F.array_distinct(text.ngrams(text.kg_tokens(F.coalesce(F.col(content), F.lit(""))), longest))).alias("surface"))
    return grams.join(surfaces, "surface").select(key, "eid").distinct()


def entity_pairs(ids: Column, most: int | None = None) -> Column:
    """ARRAY<STRUCT<a, b>> of all i < j of an array in order, the first ``most`` of them."""
    n = F.size(ids)
    pairs = F.flatten(F.transform(ids, lambda x, i: F.transform(F.slice(ids, i + 2, n), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return F.slice(pairs, 1, most) if most else pairs
