"""Topics found in the reviews of each product, from texts to names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import aspects, clusters
from ..session import read_back


def product_topics(reviews: DataFrame, k: int = 5, min_size: int = 20, dims: int = 512) -> DataFrame:
    """``product_id``, ``review_id``, ``topic_id``, ``similarity`` of every review of enough words; outliers are -1.

    ``reviews`` has product_id, review_id and clean_text.
    """
    return clusters.cluster_groups(clusters.text_vectors(reviews, dims=dims), k=k, min_size=min_size)


def discovered_topics(
    reviews: DataFrame, k: int = 5, min_size: int = 20, rules: aspects.Rules = fixed.ASPECT_RULES,
    overrides: Mapping[str, str] = fixed.ASPECT_OVERRIDES, n_terms: int = 10, stop_words: list[str] | None = None,
) -> DataFrame:
    """A row per product and topic: reviews, share of the product's reviews, heaviest terms and the name drawn from them."""
    spark, by = reviews.sparkSession, ["product_id"]
    found = read_back(spark, product_topics(reviews, k, min_size), "topics")
    texts = reviews.select("product_id", "review_id", "clean_text").join(found.select(*by, "review_id", "topic_id"), [*by, "review_id"])
    terms = aspects.top_terms(aspects.class_tfidf(texts, "topic_id", stop_words=stop_words, by=by), n_terms, "topic_id", by)
    terms = read_back(spark, terms, "topic-terms")
    named = aspects.label_topics(terms, rules, overrides, by)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank_no", "term"))), lambda t: t["term"]), ", ")
    sizes = found.groupBy(*by, "topic_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    total = found.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    return sizes.join(total, by).join(terms.groupBy(*by, "topic_id").agg(listed.alias("terms")), [*by, "topic_id"], "left").join(
        named, [*by, "topic_id"], "left"
    ).select(*by, "topic_id", "n_reviews", (F.col("n_reviews") / F.col("_all") * 100).alias("share_pct"), "terms", "topic_label")
