"""Discovery of the flagship and its rivals, identity, and the benchmark between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..functions import fixed
from ..operators import benchmark, discovery, identity, silent_killers
from ..sources import sinks


def select_products(
    reviews: DataFrame, products: DataFrame, keywords: Sequence[str] = fixed.RIVAL_TYPE_KEYWORDS,
    candidates: int = fixed.CANDIDATE_COUNT, rivals: int = fixed.RIVAL_COUNT,
) -> DataFrame:
    """Counts, rank, type vote on candidates only, then the rival rules."""
    ranked = discovery.rank_products(discovery.reviews_per_product(reviews), candidates)
    votes = discovery.product_type_vote(discovery.candidate_reviews(reviews, ranked), keywords)
    return discovery.competitors(ranked, votes, products, rivals, keywords)


def discover_products(reviews: DataFrame, products: DataFrame, **options) -> DataFrame:
    """The products table: flagship and rivals with scanned and sampled review counts."""
    caps = {k: options.pop(k) for k in ("flagship_cap", "rival_cap") if k in options}
    chosen = select_products(reviews, products, **options)
    sample = discovery.build_sample(reviews, chosen, **caps)
    return discovery.products_table(chosen, sample)


def competitor_benchmark(scored: DataFrame, products: DataFrame) -> DataFrame:
    """Benchmark of the listed products under their pooled bar, flagship first."""
    return benchmark.chart_labels(benchmark.benchmark(scored, products))


def benchmark_summary(scored: DataFrame, products: DataFrame) -> DataFrame:
    """Gap, headline and shared bar in one row."""
    scoped = scored.join(products.select("product_id"), "product_id", "left_semi")
    bar = silent_killers.pooled_threshold([scoped]).select("threshold").scalar()
    gap = benchmark.benchmark_gap(benchmark.benchmark(scored, products, bar))
    return benchmark.insight(gap).withColumn("sk_threshold_shared", bar)


def identify_and_patch(
    products: DataFrame, reviews: DataFrame, keywords: Sequence[str] = fixed.TITLE_TYPE_KEYWORDS,
    min_share: float = fixed.BRAND_MIN_SHARE, names: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Resolved identities, and the products table with them written back."""
    resolved = identity.product_identity(products, reviews, keywords, min_share, names)
    return resolved, sinks.patch_products(products, resolved.select("product_id", "brand", "title"))
