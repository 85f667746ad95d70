"""Views that give the supplied tables the shape of product reviews.

The words below are frequent tokens of the synthetic text, not real sentiment words: they exercise
the same code as the English defaults on text that holds no English review vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

POSITIVE = ["the", "is", "on", "das", "und", "el", "los", "le", "et"]
NEGATIVE = ["of", "and", "in", "der", "den", "de", "la", "des"]
ASPECTS = [
    ("Alpha", ["from", "nicht", "para", "avec"]),
    ("Beta", ["with", "mit", "con", "sur"]),
    ("Gamma", ["this", "ist", "una", "est"]),
]
EMOTIONS = {
    "anger": ["was", "auf", "por", "dans"],
    "sadness": ["by", "sich", "se", "pour"],
    "joy": ["be", "das", "del", "est"],
    "other": ["as", "are", "at", "an"],
}
LANGUAGES = fixed.LANGUAGE_STOP_WORDS
TYPE_KEYWORDS = ["nicht", "avec", "with", "para", "from", "una"]
TECHNICAL = ["Alpha"]
INSTRUCTIONAL = ["Gamma"]
LEXICON = {"positive": POSITIVE, "negative": NEGATIVE}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_hash(value: Column, salt: str) -> Column:
    digest = F.md5(F.concat(value.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _stars(h: Column) -> Column:
    p = h % 100
    return F.when(p < 8, 1.0).when(p < 16, 2.0).when(p < 26, 3.0).when(p < 46, 4.0).otherwise(5.0)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per document."""
    k = F.col("doc_id")
    day = salted_hash(k, "d") % 730
    millis = F.lit(1609459200000) + day * 86400000
    votes = salted_hash(k, "h")
    product = F.least(salted_hash(k, "p") % 12, salted_hash(k, "q") % 12)
    return table(spark, sf_dir, "documents").select(
        k.alias("review_id"),
        F.concat(F.lit("p"), product.cast("string")).alias("product_id"),
        F.col("text").alias("review_text"),
        F.col("lang"),
        F.substring("text", 1, 60).alias("review_summary"),
        _stars(salted_hash(k, "s")).alias("star_rating"),
        millis.alias("unix_time"),
        F.date_add(F.lit("2021-01-01").cast("date"), day.cast("int")).alias("review_date"),
        F.when(votes % 10 < 6, F.lit(0)).otherwise(votes % 200).cast("bigint").alias("helpful_votes"),
        (salted_hash(k, "v") % 10 < 9).alias("verified_purchase"),
    )


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored reviews without text, one per order line: the larger table."""
    d = F.col("l_discount") + F.col("l_tax") + F.lit(0.05)
    negative, positive = F.col("l_discount") / d, F.col("l_tax") / d
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("product_id"),
        (1 + F.col("l_quantity").cast("int") % 5).cast("double").alias("star_rating"),
        negative.alias("prob_negative"),
        (F.lit(0.05) / d).alias("prob_neutral"),
        positive.alias("prob_positive"),
        (positive - negative).alias("sentiment_score"),
        F.col("l_linenumber").cast("bigint").alias("helpful_votes"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        F.to_date("l_shipdate").alias("review_date"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product dimension for ``scored_lines``: brand, title and category."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("product_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
    )


def event_reviews(events: DataFrame) -> DataFrame:
    """Review arrivals from the event table, batch or streaming; event time cast to TIMESTAMP."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    negative = (k + 1) / 102.0
    return events.select(
        F.col("event_id").alias("review_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("product_id"),
        F.col("ts").cast("timestamp").alias("event_time"),
        (1 + F.col("event_id") % 5).cast("double").alias("star_rating"),
        negative.alias("prob_negative"),
        ((101 - k) / 204.0).alias("prob_positive"),
        F.col("value"),
    )
