"""Text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

WORD = r"[^ \t\n\x0b\f\r]+"


def clean_text(text: Column) -> Column:
    """Lower case, ASCII letters and digits only, single spaces.

    One pass: a run of anything else (no-break spaces included) becomes one space.
    """
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def letter_tokens(text: Column) -> Column:
    """Lower-case runs of letters in any script; the first or last entry may be empty."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def clean_tokens(text: Column) -> Column:
    return F.split(clean_text(text), " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def token_hits(tokens: Column, words: Sequence[str]) -> Column:
    """How many tokens are in ``words`` (an IN list, hashed once it is long)."""
    return F.size(F.filter(tokens, lambda t: t.isin(*words))).cast("bigint")


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """Every keyword contained in the text as a substring, in list order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(k), F.lit(k)) for k in keywords]))


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(k), F.lit(k)) for k in keywords])


def type_snippet(title: Column, text: Column, opening: int | None = None) -> Column:
    """Title and body, or only the first ``opening`` characters of the body, where reviewers name what they bought."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), truncate(F.coalesce(text, F.lit("")), opening))


def mid_sentence_names(text: Column, stop_words: Sequence[str] = fixed.BRAND_STOP_WORDS) -> Column:
    """Distinct lower-case proper-noun candidates of one text."""
    names = F.regexp_extract_all(text, F.lit(fixed.MID_SENTENCE_NAME), F.lit(1))
    lowered = F.transform(names, F.lower)
    return F.filter(F.array_distinct(lowered), lambda w: ~w.isin(*stop_words))


def truncate(text: Column, n: int | None) -> Column:
    return text if n is None else F.substring(text, 1, n)


def snippet(text: Column, n: int = 120) -> Column:
    """The first ``n`` characters with an ellipsis, always."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def quote(text: Column, limit: int = 300) -> Column:
    """Trimmed text; beyond ``limit`` it is cut three short and given an ellipsis."""
    t = F.trim(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def flat_text(text: Column) -> Column:
    """Stripped of outer white space, with newlines turned to spaces."""
    return F.replace(F.regexp_replace(text, r"\A\s+|\s+\z", ""), F.lit("\n"), F.lit(" "))


def money(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.round(amount, 0), 0))
