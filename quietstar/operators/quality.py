"""Data-quality profile of a review table and value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import read_back
from . import ranking


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; the order is only applied to the counts."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; one row.

    Columns are unpivoted first, so (column, value) pairs combine before a single shuffle instead of
    expanding every row once per distinct aggregate.
    """
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("p")).select("p.*").filter("value is not null").distinct()
    return pairs.groupBy().pivot("name", columns).count().na.fill(0)


def sample_grade(n: Column) -> Column:
    return (
        F.when(n >= 10_000, "excellent").when(n >= 5_000, "meets minimum").when(n >= 1_000, "workable").otherwise("too small")
    )


def quality_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(check, value, pass) rows from one pass over the text.

    The pass groups by text length in words, so its result has one row per distinct length; means,
    extremes and the exact median all come from that small table, which is written once.
    """
    blank = F.col("review_text").isNull() | (F.trim("review_text") == "")
    star_ok = F.col("star_rating").isin(1.0, 2.0, 3.0, 4.0, 5.0)
    by_length = df.groupBy(text.word_count(F.col("review_text")).alias("words")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
        F.count_if(F.col("star_rating").isNotNull() & ~star_ok).alias("bad_stars"),
        F.count_if(blank).alias("blank"),
        F.min("review_date").alias("first_day"),
        F.max("review_date").alias("last_day"),
    )
    lengths = read_back(df.sparkSession, by_length, "text-lengths")
    median = ranking.exact_percentiles(lengths, [], "words", {"median": 0.5}, weight="n")
    n, with_text = F.sum("n"), F.sum(F.when(F.col("words").isNotNull(), F.col("n")))
    profile = lengths.agg(
        n.cast("double").alias("rows"),
        *[(F.sum(f"null_{c}") / n * 100).alias(f"null_pct_{c}") for c in columns],
        F.sum("bad_stars").cast("double").alias("invalid_stars"),
        F.try_divide(F.sum(F.col("words") * F.col("n")), with_text).alias("words_avg"),
        F.min("words").cast("double").alias("words_min"),
        F.max("words").cast("double").alias("words_max"),
        F.sum("blank").cast("double").alias("empty_texts"),
        F.year(F.min("first_day")).cast("double").alias("first_year"),
        F.year(F.max("last_day")).cast("double").alias("last_year"),
    ).withColumn("words_median", ranking.one_value(median, "median"))
    # Few distinct ids: counted per id first, then counted again.
    products = df.groupBy("product_id").agg(F.lit(1).alias("_one")).agg(F.count("product_id").cast("double").alias("n"))
    profile = profile.withColumn("products", ranking.one_value(products, "n"))
    names = profile.columns
    passed = (
        F.when(F.col("check").startswith("null_pct_"), F.col("value") < 5)
        .when(F.col("check").isin("invalid_stars", "empty_texts"), F.col("value") == 0)
        .when(F.col("check") == "rows", F.col("value") >= 1_000)
        .otherwise(True)
    )
    return (
        profile.unpivot([], names, "check", "value")
        .withColumn("pass", passed)
        .withColumn("grade", F.when(F.col("check") == "rows", sample_grade(F.col("value"))).otherwise(""))
    )
