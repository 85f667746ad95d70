"""Flagship against rivals on one shared bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from . import silent_killers


def benchmark(df: DataFrame, products: DataFrame, threshold: Column | float | None = None) -> DataFrame:
    """Per-product volume, stars, score and silent-killer rate under one bar, with the dimension.

    ``products``: product_id, brand, title, category, is_flagship. The bar defaults to the pooled one
    over the reviews of exactly these products.
    """
    scoped = df.join(products.select("product_id"), "product_id", "left_semi")
    if threshold is None:
        threshold = silent_killers.pooled_threshold([scoped]).select("threshold").scalar()
    flagged = silent_killers.flag_silent_killers(scoped, threshold)
    summary = flagged.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.avg("star_rating").alias("avg_star"),
        F.avg("sentiment_score").alias("avg_sentiment"),
        (F.avg(F.col("is_silent_killer").cast("double")) * 100).alias("silent_killer_rate_pct"),
    )
    return summary.join(products, "product_id", "left").select(
        *summary.columns,
        F.coalesce("brand", F.lit("Unknown")).alias("brand"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("category", F.lit("Electronics")).alias("category"),
        F.coalesce("is_flagship", F.lit(False)).alias("is_flagship"),
    )


def chart_labels(comparison: DataFrame) -> DataFrame:
    """Flagship first, each row labelled for display."""
    suffix = F.when(F.col("is_flagship"), " (Flagship)").otherwise("")
    return comparison.withColumn(
        "label", F.concat(F.coalesce(labels.known(F.col("brand")), F.lit("Unknown")), suffix)
    ).orderBy(F.desc("is_flagship"), F.desc("n_reviews"), F.asc("product_id"))


def benchmark_gap(comparison: DataFrame) -> DataFrame:
    """Flagship against the unweighted mean of the rivals' means, in one row."""
    flagship = F.col("is_flagship")
    out = comparison.agg(
        F.count_if(~flagship).alias("n_competitors"),
        F.max(F.when(flagship, F.col("avg_sentiment"))).alias("flagship_avg_sentiment"),
        F.avg(F.when(~flagship, F.col("avg_sentiment"))).alias("competitor_avg_sentiment"),
        F.max(F.when(flagship, F.col("avg_star"))).alias("flagship_avg_star"),
        F.avg(F.when(~flagship, F.col("avg_star"))).alias("competitor_avg_star"),
    )
    return out.withColumn(
        "sentiment_gap", F.col("flagship_avg_sentiment") - F.col("competitor_avg_sentiment")
    ).withColumn("star_gap", F.col("flagship_avg_star") - F.col("competitor_avg_star"))


def insight(gap: DataFrame) -> DataFrame:
    """The headline sentence; null when there are no rivals."""
    direction = F.when(F.col("sentiment_gap") < 0, "below").otherwise("above")
    sentence = F.concat(
        F.lit("Mean sentiment of the flagship: "),
        F.format_string("%.3f", F.abs(F.round("sentiment_gap", 3))),
        F.lit(" "), direction, F.lit(" its rivals; difference in mean stars: "),
        F.format_string("%+.2f", F.round("star_gap", 2)),
    )
    return gap.withColumn("insight", F.when(F.col("n_competitors") > 0, sentence))
