"""Most-reviewed products, their type by vote, and their direct rivals.

Ranking happens on per-product counts; only candidate products' rows are looked at again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, fixed, labels, maths, text
from ..session import read_back
from . import ranking

# Ids of this many rows stay far below any executor's memory.
BROADCAST_ROWS = 100_000


def reviews_per_product(df: DataFrame) -> DataFrame:
    return df.groupBy("product_id").agg(F.count(F.lit(1)).alias("review_count"))


def rank_products(counts: DataFrame, n: int = fixed.CANDIDATE_COUNT) -> DataFrame:
    """The ``n`` most-reviewed products; rank 1 is the flagship. The rank runs over ``n`` rows only."""
    top = counts.orderBy(F.desc("review_count"), F.asc("product_id")).limit(n)
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("review_count"), F.asc("product_id"))
    return top.withColumn("rank_no", F.row_number().over(order).cast("bigint")).withColumn(
        "is_flagship", F.col("rank_no") == 1
    )


def candidate_reviews(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of the candidates; the id list has at most the candidate count of rows."""
    return df.join(candidates.select("product_id"), "product_id", "left_semi")


def product_type_vote(
    df: DataFrame, keywords: Sequence[str] = fixed.RIVAL_TYPE_KEYWORDS, titled: bool = True, opening: int | None = None
) -> DataFrame:
    """Most mentioned type word per product in titles and whole texts; the earlier word of the list on ties."""
    body = text.type_snippet(F.col("review_summary"), F.col("review_text"), opening) if titled else F.col("review_text")
    position = F.array_position(F.array(*[F.lit(k) for k in keywords]), F.col("keyword"))
    votes = (
        df.select("product_id", F.explode(text.keyword_hits(body, keywords)).alias("keyword"))
        .groupBy("product_id", "keyword")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    best = ranking.top_per_group(votes, ["product_id"], [F.desc("votes"), position.asc()], 1, "_n")
    return best.select("product_id", F.col("keyword").alias("product_type"), "votes")


def sample_adequacy(counts: DataFrame) -> DataFrame:
    """Cochran minimum for the scanned total, and whether each product clears it."""
    total = ranking.one_value(counts.agg(F.sum("review_count").alias("n")), "n")
    need = maths.cochran_n(total.cast("double"))
    return counts.withColumn("required", need).withColumn("adequate", F.col("review_count") >= F.col("required"))


def competitors(
    candidates: DataFrame, types: DataFrame, products: DataFrame, n: int = fixed.RIVAL_COUNT,
    keywords: Sequence[str] = fixed.RIVAL_TYPE_KEYWORDS,
) -> DataFrame:
    """Up to ``n`` rivals in volume order: the flagship's type, another brand where both are known.

    With no match the next products by volume stand in. All inputs are candidate-sized. A candidate
    without a vote takes the first type word of its title.
    """
    title_type = text.first_keyword(F.coalesce("title", F.lit("")), keywords)
    known = (
        candidates.join(types.select("product_id", "product_type"), "product_id", "left")
        .join(products.select("product_id", "title", "brand", "category"), "product_id", "left")
        .withColumn("product_type", F.coalesce("product_type", title_type))
    )
    everything = W.partitionBy(F.lit(0)).orderBy("rank_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    flagship_type = F.first("product_type").over(everything)
    brand = labels.known(F.col("brand"))
    flagship_brand = F.first(brand).over(everything)
    same_brand = F.coalesce(brand == flagship_brand, F.lit(False))
    matches = F.coalesce(F.col("product_type") == flagship_type, flagship_type.isNull())
    judged = known.withColumn("_match", (F.col("rank_no") > 1) & matches & ~same_brand)
    any_match = F.max("_match").over(everything)
    running = W.partitionBy(F.lit(0)).orderBy("rank_no").rowsBetween(W.unboundedPreceding, 0)
    return (
        judged.withColumn("_any", any_match)
        .withColumn("_pick", (F.col("rank_no") > 1) & (F.col("_match") | ~F.col("_any")))
        .withColumn("_nth", F.count_if("_pick").over(running))
        .filter(F.col("is_flagship") | (F.col("_pick") & (F.col("_nth") <= n)))
        .withColumn("is_fallback", ~F.col("is_flagship") & ~F.col("_any"))
        .select("product_id", "review_count", "rank_no", "is_flagship", "is_fallback", "product_type", "title", "brand", "category")
    )


def cap_per_product(
    df: DataFrame, selection: DataFrame, flagship_cap: int, rival_cap: int
) -> DataFrame:
    """The first reviews of each selected product, a larger cap for the flagship.

    Order is (unix_time, review_id), which is reproducible where arrival order is not. Ranking moves
    ids and times only; texts never enter a shuffle for it. The kept ids are stored, counted, and
    broadcast back only while few. A review delivered several times counts and is returned once.
    """
    cap = F.when(F.col("is_flagship"), flagship_cap).otherwise(rival_cap)
    keys = df.select("product_id", "review_id", "unix_time").join(selection.select("product_id", "is_flagship"), "product_id")
    keys = keys.groupBy("product_id", "review_id", "is_flagship").agg(F.min("unix_time").alias("unix_time"))
    ranked = ranking.first_per_group(
        keys, ["product_id"], [F.asc("unix_time"), F.asc("review_id")], cap,
        limit=max(flagship_cap, rival_cap), spread_by=F.col("review_id"), rank="arrival_no",
    )
    kept = read_back(df.sparkSession, ranked.select("product_id", "review_id", "arrival_no", "is_flagship"), "capped-ids")
    side = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    return df.join(side, ["product_id", "review_id"]).dropDuplicates(["product_id", "review_id"])


def build_sample(df: DataFrame, selection: DataFrame, **caps: int) -> DataFrame:
    """Reviews of the selection with parsed dates, unreadable rows dropped, brand and title attached.

    All of them, unless ``flagship_cap`` and ``rival_cap`` are given.
    """
    chosen = cap_per_product(df, selection, **caps) if caps else df.join(selection.select("product_id", "is_flagship"), "product_id")
    capped = chosen.withColumn(
        "review_date", F.to_date(dates.epoch_to_timestamp(F.col("unix_time")))
    )
    described = selection.select(
        "product_id", F.coalesce("brand", F.lit("Unknown")).alias("brand"), F.coalesce("title", F.lit("")).alias("product_title")
    )
    return capped.na.drop(subset=["review_text", "review_date"]).join(described, "product_id", "left")


def products_table(selection: DataFrame, sample: DataFrame) -> DataFrame:
    kept = sample.groupBy("product_id").agg(F.count(F.lit(1)).alias("sampled_review_count"))
    return selection.join(kept, "product_id", "left").select(
        "product_id",
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.coalesce("brand", F.lit("Unknown")).alias("brand"),
        F.coalesce("category", F.lit("Electronics")).alias("category"),
        F.col("review_count").alias("scanned_review_count"),
        F.coalesce("sampled_review_count", F.lit(0)).cast("bigint").alias("sampled_review_count"),
        "is_flagship",
    )
