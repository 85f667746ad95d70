"""Complaint corpora and extractive summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, maths, text
from ..session import read_back
from . import ranking

#: Chosen sentences up to here are broadcast, more are joined by shuffle.
BROADCAST_ROWS = 100_000


def complaints(df: DataFrame) -> DataFrame:
    """Negative score, low stars, or a silent killer."""
    killer = F.col("is_silent_killer") if "is_silent_killer" in df.columns else F.lit(False)
    return df.filter(
        (F.col("sentiment_score") < -0.1) | (F.col("star_rating") <= 2) | F.coalesce(killer, F.lit(False))
    )


def build_corpus(
    df: DataFrame, by: Sequence[str], max_reviews: int = fixed.SUMMARY_MAX_REVIEWS,
    max_chars: int = fixed.SUMMARY_MAX_CHARS, seed: int | str = 42, min_reviews: int = 1,
) -> DataFrame:
    """A reproducible sample of each group's complaints packed into a character budget.

    Texts of at least 20 words go first; when a group has any, shorter ones are left out. A text that
    would overflow is skipped and packing goes on; when none fits, the shortest is cut to the budget.
    At most ``max_reviews`` texts per group are ever gathered.
    """
    body = text.flat_text(F.col("review_text"))
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_complaints"))
    pool = (
        df.select(*by, "review_id", body.alias("_text"))
        .withColumn("_long", text.word_count(F.col("_text")) >= fixed.SUMMARY_MIN_WORDS)
        .withColumn("_key", maths.seeded_key(F.col("review_id"), seed))
    )
    order = [F.desc("_long"), F.asc("_key"), F.asc("review_id")]
    picked = ranking.top_per_group(pool, by, order, max_reviews, "_n", spread_by=F.col("review_id"))
    gathered = picked.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("_n", "_long", "_text"))).alias("_rows")
    )
    any_long = F.exists("_rows", lambda r: r["_long"])
    texts = F.transform(F.filter("_rows", lambda r: r["_long"] | ~any_long), lambda r: r["_text"])
    usable = F.filter(texts, lambda t: t != "")
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def pack(acc, t):
        fits = acc["used"] + F.length(t) <= max_chars
        return F.struct(
            F.when(fits, acc["used"] + F.length(t)).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(t))).otherwise(acc["kept"]).alias("kept"),
        )

    shortest = F.array_min(F.transform(F.col("_texts"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    return (
        gathered.select(*by, usable.alias("_texts"))
        .withColumn("_packed", F.aggregate("_texts", start, pack)["kept"])
        .withColumn(
            "corpus",
            F.when(F.size("_packed") > 0, F.array_join("_packed", " ")).otherwise(
                F.coalesce(F.substring(shortest, 1, max_chars), F.lit(""))
            ),
        )
        .withColumn("n_used", F.size("_packed").cast("bigint"))
        .join(totals, list(by))
        .filter(F.col("n_complaints") >= min_reviews)
        .select(*by, "n_complaints", "n_used", "corpus")
    )


def summarize(
    df: DataFrame, by: Sequence[str] = ("product_id", "topic_label"), sentences: int = 2, min_reviews: int = 1,
) -> DataFrame:
    """Extractive summary: of all sentences of each group's complaints those with the most typical words.

    A word weighs its frequency in the group times ln(1 + N/df) over all N groups; a sentence scores the mean
    weight of its words. Equal sentences of a group are scored once, at their first place, and count as often as
    they occur. They are written once, numbered, because weights and scores both read them; words and ranking move numbers only.
    A group without any sentence has an empty summary.
    """
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_complaints"))
    parts = F.filter(
        F.transform(F.split(text.flat_text(F.col("review_text")), r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != ""
    )
    said = df.select(*by, "review_id", F.posexplode(parts).alias("sentence_no", "sentence"))
    distinct = said.groupBy(*by, "sentence").agg(
        F.count(F.lit(1)).alias("_times"), F.min(F.struct("review_id", "sentence_no")).alias("_place")
    )
    # Numbers of neighbours follow each other and compress, digests would not; stored, they no longer change.
    lines = read_back(df.sparkSession, distinct.withColumn("_key", F.monotonically_increasing_id()), "sentences")
    n_groups = ranking.one_value(totals.agg(F.count(F.lit(1)).alias("n")), "n")
    words = lines.select(
        *by, "_key", "_times", F.explode(text.letter_tokens(F.col("sentence"))).alias("word")
    ).filter("word <> ''")
    tf = words.groupBy(*by, "word").agg(F.sum("_times").alias("tf"))
    df_ = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weights = tf.join(df_, "word").select(*by, "word", (F.col("tf") * F.log(1 + n_groups / F.col("df"))).alias("w"))
    scores = words.join(weights, [*by, "word"]).groupBy(*by, "_key").agg(F.avg("w").alias("score"))
    placed = lines.select(*by, "_key", "_place").join(scores, [*by, "_key"])
    order = [F.desc(F.round("score", 6)), F.asc("_place")]
    best = ranking.top_per_group(placed, by, order, sentences, spread_by=F.col("_key"))
    best = read_back(df.sparkSession, best.select(*by, "_key"), "best")
    # The chosen few go to the sentences, which then stay where they are; very many groups meet them by shuffle.
    best = F.broadcast(best) if best.count() <= BROADCAST_ROWS else best
    joined = lines.join(best, [*by, "_key"]).groupBy(*by).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_place", "sentence"))), lambda s: s["sentence"]), ". "
        ).alias("summary")
    )
    return (
        totals.filter(F.col("n_complaints") >= min_reviews)
        .join(joined, list(by), "left")
        .select(*by, F.coalesce("summary", F.lit("")).alias("summary"), "n_complaints")
    )
