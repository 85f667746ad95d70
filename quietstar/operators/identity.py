"""What a product is called and who makes it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, labels, text
from . import discovery, ranking


def guess_brand(
    df: DataFrame, min_share: float = fixed.BRAND_MIN_SHARE, names: Column | None = None
) -> DataFrame:
    """Most frequent mid-sentence name per product, counted once per review, with enough share.

    ``names`` replaces the name extraction (an array column of distinct lower-case words per review).
    """
    found = text.mid_sentence_names(F.col("review_text")) if names is None else names
    totals = df.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    counts = (
        df.select("product_id", F.explode(found).alias("word"))
        .groupBy("product_id", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = ranking.top_per_group(counts, ["product_id"], [F.desc("n"), F.asc("word")], 1, "_rank")
    return (
        best.join(totals, "product_id")
        .withColumn("share", F.col("n") / F.col("n_reviews"))
        .filter(F.col("share") >= min_share)
        .select("product_id", F.initcap("word").alias("guessed_brand"), "n", "share")
    )


def resolve_identity(products: DataFrame, brands: DataFrame, types: DataFrame) -> DataFrame:
    """Official metadata, else the review-text guess, else unresolved, tagged with its source."""
    official, guessed = labels.known(F.col("brand")), F.col("guessed_brand")
    official_title = F.coalesce(labels.known(F.col("title")), F.lit(""))
    source = (
        F.when(official.isNotNull(), "metadata")
        .when(guessed.isNotNull(), "review-text (best-effort)")
        .otherwise("unresolved")
    )
    guessed_title = F.coalesce(F.nullif(official_title, F.lit("")), F.initcap("product_type"), F.lit(""))
    title = F.when(official.isNull() & guessed.isNotNull(), guessed_title).otherwise(official_title)
    return (
        products.join(brands.select("product_id", "guessed_brand"), "product_id", "left")
        .join(types.select("product_id", "product_type"), "product_id", "left")
        .withColumn("resolved_brand", F.coalesce(official, guessed, F.lit("Unknown")))
        .withColumn("resolved_title", title)
        .withColumn("brand_source", source)
        .drop("brand", "title", "guessed_brand", "product_type")
        .withColumnsRenamed({"resolved_brand": "brand", "resolved_title": "title"})
    )


def product_identity(
    products: DataFrame, df: DataFrame, keywords: Sequence[str] = fixed.TITLE_TYPE_KEYWORDS,
    min_share: float = fixed.BRAND_MIN_SHARE, names: Column | None = None,
) -> DataFrame:
    """Identity of every listed product; guesses count only for products without a brand.

    Names and type words of all reviews are counted where they lie and only counts are shuffled. To leave out the reviews of
    products with a brand, whole texts would have to meet the products, those of a popular one in one task.
    """
    brands = guess_brand(df, min_share, names)
    types = discovery.product_type_vote(df, keywords, titled=False)
    return resolve_identity(products, brands, types)


def sibling_products(candidates: DataFrame) -> DataFrame:
    """Candidates that share the flagship's known brand."""
    flagship = candidates.filter("is_flagship").select(labels.known(F.col("brand")).alias("brand")).agg(
        F.max("brand").alias("brand")
    )
    return candidates.filter(~F.col("is_flagship") & (labels.known(F.col("brand")) == ranking.one_value(flagship, "brand")))
