"""Reading claims, fused probabilities and parameters out of result files whose members changed their names over time.

All columns are VARIANT expressions inside the JVM; a member of another shape counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions import scores, text
from claimlake.functions.text import norm
from claimlake.operators import claims

# Fixed value: the prompt of a checker that answers with one token.
ONE_TOKEN_PROMPT = "You are an NLI checker. Read the claim and the evidence, then answer with ONE token: <entailed> or <contradicted> or <neutral>.\n\nClaim: %s\n\nEvidence: %s\n\nAnswer:"


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def members(v: Column) -> Column:
    """The members of an object; none of anything else."""
    return F.coalesce(v.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))


def has(v: Column, key: str) -> Column:
    return F.map_contains_key(members(v), key)


def _object(v: Column, key: str) -> Column:
    return get(v, key, "map<string,variant>").isNotNull()


def _triple(v: Column, *paths: str) -> Column:
    return F.struct(*(scores.safe_double(get(v, p)).alias(n) for p, n in zip(paths, ("e", "n", "c"))))


def claim_probabilities(v: Column) -> Column:
    """STRUCT<e, n, c> of a claim: members of ``probs`` if it is an object, else of ``nli``, else 0."""
    zero = F.struct(*(F.lit(0.0).alias(n) for n in "enc"))
    return F.when(_object(v, "probs"), _triple(v, "probs.entailed", "probs.neutral", "probs.contradicted")).when(_object(v, "nli"), _triple(v, "nli.p_entailed", "nli.p_neutral", "nli.p_contradicted")).otherwise(zero)


def fused_probabilities(v: Column) -> Column:
    """STRUCT<e, n, c> of ``kg_fused`` if it is an object, else of ``fused``; null unless all three are there."""
    out = None
    for key in ("kg_fused", "fused"):
        names = [f"{key}.p_entailed", f"{key}.p_neutral", f"{key}.p_contradicted"]
        full = F.when(F.lit(True) & get(v, names[0]).isNotNull() & get(v, names[1]).isNotNull() & get(v, names[2]).isNotNull(), _triple(v, *names))
        out = F.when(_object(v, key), full) if out is None else out.when(_object(v, key), full)
    return out


def graph_score(v: Column) -> Column:
    return scores.safe_double(get(v, "kg_score"))


def graph_hit(v: Column) -> Column:
    """``kg_hit`` where it is present (null counts as false), else whether the score is over 0."""
    said = F.coalesce(get(v, "kg_hit", "boolean"), get(v, "kg_hit", "double") != 0, F.coalesce(get(v, "kg_hit"), F.lit("")) != "")
    return F.when(has(v, "kg_hit"), F.coalesce(said, F.lit(False))).otherwise(graph_score(v) > 0)


def flat_probabilities(v: Column) -> Column:
    """STRUCT<query_id, claim_idx, e, c, n, gold> of a flat claim record: probabilities of ``nli`` or of the record itself under
    either spelling, the gold label or where that member is absent the teacher's; null if anything but the label is missing."""
    def p(*names: str) -> Column:
        own = F.when(has(v, "nli"), F.coalesce(*(get(v, f"nli.{n}", "double") for n in names))).otherwise(F.coalesce(*(get(v, n, "double") for n in names)))
        return own

    e, n, c = p("p_entailed", "p_entail"), p("p_neutral"), p("p_contradicted", "p_contra")
    gold = F.when(has(v, "gold_label"), get(v, "gold_label")).otherwise(get(v, "teacher_label"))
    q, i = get(v, "query_id"), get(v, "claim_idx", "int")
    full = q.isNotNull() & i.isNotNull() & e.isNotNull() & n.isNotNull() & c.isNotNull()
    return F.when(full, F.struct(q.alias("query_id"), i.alias("claim_idx"), e.alias("e"), c.alias("c"), n.alias("n"), gold.alias("gold")))


def fusion_parameters(doc: Column, listed: Column, first: int = 50) -> Column:
    """STRUCT<alpha, beta, fusion_type> of a result file: its ``kg_fusion_config`` (both may be there, beta names the type),
    else the first of its first claims whose ``kg_fused`` has one (alpha before beta), else unknown."""
    num = lambda v, p: F.when(has_path(v, p), scores.safe_double(get(v, p)))

    def has_path(v: Column, p: str) -> Column:
        head, key = p.split(".")
        return F.map_contains_key(F.coalesce(get(v, head, "map<string,variant>"), F.create_map().cast("map<string,variant>")), key)

    a, b = num(doc, "kg_fusion_config.alpha"), num(doc, "kg_fusion_config.beta")
    some = F.filter(F.slice(listed, 1, first), lambda c: has_path(c, "kg_fused.alpha") | has_path(c, "kg_fused.beta"))
    one = F.try_element_at(some, F.lit(1))
    ca = num(one, "kg_fused.alpha")
    cb = F.when(ca.isNull(), num(one, "kg_fused.beta"))
    own = a.isNotNull() | b.isNotNull()
    alpha, beta = F.when(own, a).otherwise(ca), F.when(own, b).otherwise(cb)
    kind = F.when(b.isNotNull(), "beta").when(a.isNotNull(), "alpha").when(ca.isNotNull(), "alpha").when(cb.isNotNull(), "beta").otherwise("unknown")
    return F.struct(alpha.alias("alpha"), beta.alias("beta"), kind.alias("fusion_type"))


def leading_triples(v: Column) -> Column:
    """ARRAY<STRUCT<s, r, o>> of claims with three members at least, their first three."""
    lists = F.transform(F.coalesce(v.try_cast("array<variant>"), F.array().cast("array<variant>")), lambda x: x.try_cast("array<variant>"))
    long = F.filter(lists, lambda x: x.isNotNull() & (F.size(x) >= 3))
    return F.transform(long, lambda x: F.struct(*(F.try_variant_get(x[i], "$", "string").alias(n) for i, n in enumerate("sro"))))


def with_claim_texts(rows: DataFrame, lookup: DataFrame, keys: tuple[str, ...] = ("query_id", "claim_idx"), name: str = "claim_text") -> DataFrame:
    """``rows`` with the claim text of the row itself, else the one looked up, else an empty one."""
    found = lookup.groupBy(*keys).agg(F.max(name).alias("_t"))
    return rows.join(found, list(keys), "left").withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), F.col("_t"), F.lit(""))).drop("_t")


def nli_pairs(rows: DataFrame, key: str, listed: str, evidence: str, labels: str, least_overlap: float = 0.0) -> DataFrame:
    """(key, claim_no, doc_no, prompt, label): every claim and document with a known label by position; nothing is
    deduplicated or dropped for its length, so positions stay aligned."""
    c = rows.select(key, evidence, labels, F.posexplode(F.transform(listed, norm)).alias("claim_no", "claim")).where("claim <> ''")
    p = c.select(key, "claim_no", "claim", labels, F.posexplode(F.transform(evidence, norm)).alias("doc_no", "ev")).where("ev <> ''")
    raw = F.try_element_at(F.try_element_at(labels, F.col("claim_no") + 1), F.col("doc_no") + 1)
    p = p.withColumn("label", F.coalesce(*(F.when(raw == k, v) for k, v in text.LABEL_CANON.items()))).where("label IS NOT NULL")
    if least_overlap > 0:
        words = lambda x: F.array_distinct(F.split(F.lower(x), " "))
        p = p.where(text.jaccard(words("claim"), words("ev")) >= least_overlap)
    return p.select(key, "claim_no", "doc_no", F.format_string(ONE_TOKEN_PROMPT, "claim", "ev").alias("prompt"), "label")


def side_target(v: Column) -> Column:
    """STRUCT<triples, claims> of a prediction record: valid triples of pred_triples, else of pred_claims, else the texts of pred_claims."""
    own, other = claims.triples(get(v, "pred_triples", "variant")), claims.triples(get(v, "pred_claims", "variant"))
    found = F.when(F.size(own) > 0, own).when(F.size(other) > 0, other)
    plain = F.filter(F.transform(F.coalesce(get(v, "pred_claims", "array<variant>"), F.array().cast("array<variant>")), lambda x: norm(F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull() & (x != ""))
    return F.struct(found.alias("triples"), F.when(found.isNull() & (F.size(plain) > 0), plain).alias("claims"))


def unified_targets(items: DataFrame, teacher: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """``items`` with teacher_triples, teacher_claims, gt_triples, gt_claims and target, the JSON text to learn from: gold
    triples before the teacher's, triples before claims, null if there is none.  Sides are (key, v), one row a key."""
    j = items
    for name, side in (("teacher", teacher), ("gt", gold)):
        j = j.join(side.select(key, side_target(F.col("v")).alias(f"_{name}")), key, "left").withColumns({f"{name}_triples": F.col(f"_{name}.triples"), f"{name}_claims": F.col(f"_{name}.claims")}).drop(f"_{name}")
    triples, listed = F.coalesce("gt_triples", "teacher_triples"), F.coalesce("gt_claims", "teacher_claims")
    texts = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)), ", "), F.lit("]"))
    return j.withColumn("target", F.coalesce(claims.json_rows(triples), texts))


def grouped_f1(pairs: DataFrame, group: list[str], true: str, pred: str, labels: tuple[str, ...] = ("entailed", "contradicted", "neutral")) -> DataFrame:
    """(group, n, accuracy, macro_f1, f1_<label>) of the rows with a true label; all null where a group has none.  One shuffle."""
    t, p = F.col(true), F.col(pred)
    known = t.isNotNull()
    f1, aggs = {}, [F.count_if(known).alias("n"), F.count_if(known & t.eqNullSafe(p)).alias("_ok")]
    for i, x in enumerate(labels):
        aggs += [F.count_if(known & t.eqNullSafe(x) & p.eqNullSafe(x)).alias(f"_tp{i}"), F.count_if(known & p.eqNullSafe(x)).alias(f"_p{i}"), F.count_if(t.eqNullSafe(x)).alias(f"_t{i}")]
        # 2PR/(P+R) is 2tp over predicted plus true
        f1[x] = F.coalesce(F.try_divide(2.0 * F.col(f"_tp{i}"), F.col(f"_p{i}") + F.col(f"_t{i}")), F.lit(0.0))
    d = pairs.groupBy(*group).agg(*aggs) if group else pairs.agg(*aggs)
    some = lambda c: F.when(F.col("n") > 0, c)
    return d.select(*group, "n", some(F.col("_ok") / F.col("n")).alias("accuracy"), some(sum(f1.values(), F.lit(0.0)) / len(labels)).alias("macro_f1"), *(some(f).alias(f"f1_{x.lower()}") for x, f in f1.items()))


def error_rate(rows: DataFrame, group: list[str], critical: Column, wrong: Column) -> DataFrame:
    """(group, n_critical, error_rate): share of the safety-critical rows that are wrong; null without any."""
    return rows.groupBy(*group).agg(F.count_if(critical).alias("n_critical"), F.avg(F.when(critical, F.coalesce(wrong, F.lit(False)).cast("double"))).alias("error_rate"))


def alias_groups(names: DataFrame, name: str = "name", raw_id: str = "raw_id") -> DataFrame:
    """(kind, raw_id, aliases): the filled, distinct names of each entity by its type, the part of the id before two colons."""
    d = names.select(text.strip(F.col(name)).alias("name"), text.strip(F.col(raw_id)).alias("raw_id")).where("name <> '' AND raw_id <> ''")
    kind = F.when(F.col("raw_id").contains("::"), F.split("raw_id", "::")[0]).otherwise("Unknown")
    return d.groupBy(kind.alias("kind"), "raw_id").agg(F.array_sort(F.collect_set("name")).alias("aliases"))  # names of one entity
