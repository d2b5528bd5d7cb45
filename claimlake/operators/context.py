"""Packing retrieved texts into a token budget (per-row folds inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlake.functions.text import strip, token_estimate

# Fixed value: the answering prompt around question and context.
ANSWER_PROMPT = """You are a helpful medical assistant. Answer the user's question **faithfully** using the provided context only. If the answer is not in the context, say "I don't know" and do NOT hallucinate.

# Question
{question}

# Context
{context}

# Instructions
- Prefer concise, clinical language.
- Cite snippets implicitly (no numbered refs needed).
"""
PROMPT_CHARS = len(ANSWER_PROMPT.format(question="", context=""))


def answer_prompt(question: Column, texts: Column) -> Column:
    """The answering prompt with one bullet a text."""
    before, rest = ANSWER_PROMPT.split("{question}")
    middle, after = rest.split("{context}")
    bullets = F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), F.coalesce(t, F.lit("")))), "\n\n")
    return F.concat(F.lit(before), F.coalesce(question, F.lit("")), F.lit(middle), bullets, F.lit(after))


def prompt_tokens(question: Column, context_chars: Column) -> Column:
    """Estimated tokens of a prompt with so many characters of context."""
    return F.greatest(F.lit(1), F.floor((F.lit(PROMPT_CHARS) + F.length(question) + context_chars) / 4)).cast("int")


def pack(question: Column, texts: Column, window: int, max_new: int, margin: int, max_docs: int, max_chars: int) -> Column:
    """ARRAY<STRING> of the texts that fit: greedy in order, the first that overflows cut to the longest prefix
    that fits, nothing after it.  Each text is first cut to ``max_chars``; with the length-based token estimate
    the prefix length has a closed form.  Each text costs its length plus 2 characters of bullet, and 2 more
    of gap after the first.
    """
    budget = window - max_new - margin
    room = F.lit(4 * (budget + 1) - 1) - F.lit(PROMPT_CHARS) - F.length(question)  # most characters of context
    cut = F.transform(F.slice(texts, 1, max_docs), lambda t: F.substring(F.coalesce(t, F.lit("")), 1, max_chars))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("int").alias("used"), F.lit(False).alias("full"))

    def add(s: Column, t: Column) -> Column:
        head = F.when(F.size(s["kept"]) > 0, 4).otherwise(2)
        left = (room - s["used"] - head).cast("int")
        fits = F.length(t) <= left
        part = F.substring(t, F.lit(1), F.greatest(F.lit(0), left))
        kept = F.when(fits, F.array_append(s["kept"], t)).when(F.length(part) > 0, F.array_append(s["kept"], part)).otherwise(s["kept"])
        return F.when(s["full"], s).otherwise(F.struct(kept.alias("kept"), F.when(fits, s["used"] + head + F.length(t)).otherwise(s["used"]).cast("int").alias("used"), (~fits).alias("full")))

    packed = F.aggregate(cut, start, add)["kept"]
    return F.when(prompt_tokens(question, F.lit(0)) >= budget, F.array().cast("array<string>")).otherwise(packed)


def trim_to_limit(question: Column, texts: Column, limit: int, max_new: int, extra: int = 64) -> Column:
    """The longest run of first texts whose prompt stays in the limit; none if not even the empty prompt does."""
    budget = limit - max_new - extra
    lengths = F.transform(texts, lambda t: F.length(F.coalesce(t, F.lit(""))))
    size = lambda n: F.aggregate(F.slice(lengths, 1, n), F.lit(0), lambda s, x: s + x + 2) + 2 * F.greatest(F.lit(0), n - 1)
    counts = F.when(F.size(texts) > 0, F.sequence(F.lit(1), F.size(texts))).otherwise(F.array().cast("array<int>"))
    best = F.array_max(F.filter(counts, lambda n: prompt_tokens(question, size(n)) <= budget))
    return F.slice(texts, 1, F.coalesce(best, F.lit(0)))


def pack_numbered(texts: Column, max_docs: int = 8, max_chars: int = 1200, total: int = 12_000) -> Column:
    """Numbered blocks of the non-blank texts among the first ``max_docs``, up to a total of characters; numbers count blanks."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("int").alias("used"), F.lit(False).alias("full"))
    numbered = F.transform(F.slice(texts, 1, max_docs), lambda t, i: F.struct(F.substring(strip(F.coalesce(t, F.lit(""))), 1, max_chars).alias("t"), (i + 1).alias("n")))

    def add(s: Column, x: Column) -> Column:
        over = s["used"] + F.length(x["t"]) > total
        block = F.concat(F.lit("[Doc "), x["n"].cast("string"), F.lit("]\n"), x["t"])
        more = F.struct(F.array_append(s["kept"], block).alias("kept"), (s["used"] + F.length(x["t"])).cast("int").alias("used"), F.lit(False).alias("full"))
        stop = F.struct(s["kept"].alias("kept"), s["used"].alias("used"), F.lit(True).alias("full"))
        return F.when(s["full"] | (x["t"] == ""), s).when(over, stop).otherwise(more)

    return F.array_join(F.aggregate(numbered, start, add)["kept"], "\n\n")


def completion_budget(window: int, max_new: int, used: Column) -> Column:
    """Tokens that may be generated: what the window leaves, at most ``max_new``, at least 1."""
    return F.greatest(F.lit(1), F.least(F.lit(max_new), F.greatest(F.lit(0), F.lit(window - 1) - used)))


def overflow(window: int, max_new: int, margin: int, used: Column) -> Column:
    """Whether a prompt must be skipped."""
    return used > F.lit(window - max_new - margin)


__all__ = ["answer_prompt", "completion_budget", "overflow", "pack", "pack_numbered", "prompt_tokens", "token_estimate", "trim_to_limit"]
