"""Computing expensive columns exactly once per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator.

    Catalyst pushes a filter on a derived column below its projection by repeating the expression; for
    a tokenised text that means tokenising again in every comparison. It never pushes one through a
    generator's output, while filters on other columns still reach the scan.
    """
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select("*", made)


def lexicon_hits(df: DataFrame, text_col: str, classes: Mapping[str, Sequence[str]]) -> DataFrame:
    """One count column per class of words, from a single tokenisation.

    Tokens outside every class drop out in one hashed pass; the classes are then counted on what is
    left.
    """
    wanted = sorted({w for words in classes.values() for w in words})
    kept = F.filter(text.letter_tokens(F.col(text_col)), lambda t: t.isin(*wanted))
    tokens = df.withColumn("_lexicon_tokens", kept)
    counted = {name: text.token_hits(F.col("_lexicon_tokens"), words) for name, words in classes.items()}
    return compute_once(tokens, counted).drop("_lexicon_tokens")


def spread_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition by key into the session's shuffle partition count, exempt from coalescing.

    For groups that are small in bytes but costly in Python: adaptive execution sizes partitions by
    bytes and would put thousands of such groups into one task. A following group-by on the same keys
    needs no further shuffle.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)
