"""Column functions on text: white space, tokens, surfaces, labels, hashes (all inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Unicode or Python counts as white space, as both Java and RE2 read it.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The token patterns of entity linking and of lexical search.
KG_TOKEN = r"[a-z0-9]+(?:[a-z0-9\-_/]+)?"
BM25_TOKEN = r"[a-zA-Z0-9_#+\-]+"
# Dosage-form words that entity names lose.
DOSAGE_WORDS = ("tablets?", "capsules?", "injection", "solution", "suspension", "cream", "gel", "patch", "drops?", "spray", "mg", "ml", "mcg", "units?")
# Canonical labels and their aliases, in the order in which prefixes are tried.
LABELS = ("entailed", "contradicted", "neutral")
LABEL_CANON = {"Entailment": "entailed", "Contradiction": "contradicted", "Neutral": "neutral"}
LABEL_ALIASES = {
    "entailed": ("entailed", "entail", "entails", "supported", "yes"),
    "contradicted": ("contradicted", "contradict", "refuted", "no"),
    "neutral": ("neutral", "unknown", "insufficient", "not enough info", "not enough information", "uncertain"),
}
STRICT_LABELS = {"entail": "entailed", "entailed": "entailed", "supported": "entailed", "contradict": "contradicted", "contradicted": "contradicted", "refuted": "contradicted", "neutral": "neutral", "unknown": "neutral"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), SPACE + "+", " "))


def surface(c: Column | str) -> Column:
    """Lower-case normalised form under which names are looked up."""
    return norm(F.lower(col(c)))


def strip(c: Column | str) -> Column:
    """No white space of any kind at the ends."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def paragraphs(c: Column | str) -> Column:
    """Clean spaces and long gaps, keeping single and double line feeds."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def biomed(c: Column | str) -> Column:
    """Entity-name form: no bracketed parts, no dosage words, only a-z 0-9 + / - and spaces."""
    s = F.regexp_replace(strip(F.lower(col(c))), r"\([^\n]*?\)|\[[^\n]*?\]", " ")
    s = F.regexp_replace(s, r"\b(?:" + "|".join(DOSAGE_WORDS) + r")\b", " ")
    return norm(F.regexp_replace(s, r"[^a-z0-9+/\s-]", " "))


def claim_form(c: Column | str) -> Column:
    """Form in which claims are compared: lower case, one space, no full stops and commas."""
    return F.trim(F.translate(surface(c), ".,", ""))


def kg_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(KG_TOKEN), F.lit(0))


def bm25_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(BM25_TOKEN), F.lit(0))


def ngrams(tokens: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` tokens, joined by spaces; empty for no tokens."""
    n = F.size(tokens)
    of = lambda k: F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*(F.when(n >= k, of(k)).otherwise(none) for k in range(1, longest + 1))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def triple_sentence(s: Column, r: Column, o: Column) -> Column:
    return F.concat(s, F.lit(" "), r, F.lit(" "), o, F.lit("."))


def sentences(c: Column | str) -> Column:
    """Sentences of a text as claims: cut after . ! ? before white space, normalised, without empty ones."""
    return F.filter(F.transform(F.split(col(c), r"(?<=[.!?])\s+"), norm), lambda x: x != "")


def label_exact(c: Column | str) -> Column:
    """The three dataset labels in any letter case; else null."""
    titled = F.initcap(F.lower(col(c)))
    return F.coalesce(*(F.when(titled == k, v) for k, v in LABEL_CANON.items()))


def label_free(c: Column | str, strict: bool = False) -> Column:
    """Label of a model's free answer: alias prefixes in order, then key words.

    "no" is a prefix of "not sure" and "none", which therefore count as contradicted; ``strict``
    asks for the whole word instead.
    """
    t = F.trim(F.replace(F.replace(F.lower(strip(c)), F.lit("."), F.lit("")), F.lit("label:"), F.lit("")))
    end = r"(?:[^a-z].*)?$" if strict else ""
    out = None
    order = ("neutral", "entailed", "contradicted") if strict else LABEL_ALIASES
    for label in order:
        hit = t.rlike("^(?:" + "|".join(LABEL_ALIASES[label]) + ")" + end)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    out = out.when(t.contains("contrad") | t.contains("refut"), "contradicted")
    out = out.when(t.contains("neutral") | t.contains("insufficient") | t.contains("not enough") | t.contains("uncertain"), "neutral")
    return out.when(t.contains("entail") | t.contains("support") | (t == "y"), "entailed")


def label_strict(c: Column | str) -> Column:
    """Exact alias lookup; unknown gives null."""
    t = F.lower(strip(c))
    return F.coalesce(*(F.when(t == k, v) for k, v in STRICT_LABELS.items()))


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha1(col(c)), 1, 16)


def entity_type(c: Column | str) -> Column:
    """Type prefix of an entity id such as Disease::X."""
    return F.when(col(c).contains("::"), F.split_part(col(c), F.lit("::"), F.lit(1))).otherwise("Unknown")


def aliases(c: Column | str, least: int = 3, most: int = 6) -> Column:
    """Surfaces of an entity name: itself, its last part after each separator, its forms without _ and -."""
    raw = strip(c)
    last = [F.when(raw.contains(s), F.element_at(F.split(raw, p), -1)) for s, p in (("::", "::"), (":", ":"), ("/", "/"), ("|", r"\|"))]
    forms = F.array(raw, *last, F.translate(raw, "_", " "), F.translate(raw, "-", " "))
    forms = F.transform(F.filter(forms, lambda x: x.isNotNull()), surface)
    return F.slice(F.array_distinct(F.filter(forms, lambda x: F.length(x) >= least)), 1, most)


def numeric_entities(c: Column) -> Column:
    """Decimal and hexadecimal character references as their characters; numbers that are no character give U+FFFD."""
    def one(p: Column, i: Column) -> Column:
        body = F.regexp_extract(p, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        n = F.when(F.lower(body).startswith("x"), F.conv(F.substring(body, 2, 6), 16, 10)).otherwise(body).try_cast("long")
        good = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, n).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(i == 0, p).when(body == "", F.concat(F.lit("&#"), p)).otherwise(F.concat(char, F.substring(p, F.length(body) + 2, F.length(p))))

    return F.array_join(F.transform(F.split(c, "&#"), one), "")


# Named character references that prose uses.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "deg": "°", "micro": "µ", "times": "×", "eacute": "é", "amp": "&"}


def html_text(c: Column | str) -> Column:
    """Visible text: no script, style and noscript parts, no tags, character references decoded, white space collapsed."""
    s = F.regexp_replace(col(c), r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    s = numeric_entities(s)
    for a, b in ENTITIES.items():
        s = F.replace(s, F.lit(f"&{a};"), F.lit(b))
    return norm(s)


def first_filled(*cs: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def token_estimate(c: Column) -> Column:
    """Tokens of a text by length: a quarter of its characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")
