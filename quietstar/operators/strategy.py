"""Priorities, roadmap, what-if simulations and money per aspect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, labels, maths
from . import ranking

PRODUCT = ("product_id",)


def customer_segments(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", labels.segment(F.col("star_rating"), F.col("sentiment_score")))


def priority_matrix(stats: DataFrame) -> DataFrame:
    return stats.withColumn("quadrant", labels.quadrant(F.col("frequency_pct"), F.col("emotional_intensity")))


def roadmap(
    matrix: DataFrame, by: Sequence[str] = PRODUCT, technical=fixed.TECHNICAL_ASPECTS,
    instructional=fixed.INSTRUCTIONAL_ASPECTS,
) -> DataFrame:
    intensity = F.col("emotional_intensity")
    return matrix.select(
        *by,
        F.col("topic_label").alias("aspect"),
        "quadrant",
        F.round(intensity, 3).alias("intensity"),
        labels.roadmap_tier(intensity).alias("tier"),
        labels.roadmap_action(F.col("topic_label"), intensity, technical=technical, instructional=instructional).alias("action"),
    )


def top_aspects(stats: DataFrame, n: int = 3, by: Sequence[str] = PRODUCT) -> DataFrame:
    order = [F.desc(F.round("emotional_intensity", 9)), F.asc("topic_label")]
    return ranking.top_per_group(stats, by, order, n)


def aspect_weights(stats: DataFrame, by: Sequence[str] = PRODUCT) -> DataFrame:
    total = F.sum("frequency_pct").over(W.partitionBy(*by))
    return stats.withColumn("weight", maths.ratio(F.col("frequency_pct"), total))


def roi_target(stats: DataFrame, by: Sequence[str] = PRODUCT) -> DataFrame:
    """The angriest aspect per product; the alphabetically first on ties."""
    order = [F.desc(F.round("mean_anger", 9)), F.asc("topic_label")]
    best = ranking.top_per_group(stats, by, order, 1, "_n")
    return best.select(*by, F.col("topic_label").alias("target_aspect"), "mean_anger", F.col("mean_sentiment").alias("target_mean"))


def roi_simulation(
    df: DataFrame, stats: DataFrame, by: Sequence[str] = PRODUCT, target: float = fixed.ROI_TARGET_SENTIMENT
) -> DataFrame:
    """Shift the angriest aspect's scores to a neutral and to a positive mean, clip, and compare.

    Only the target aspect's rows are touched again: the other rows enter as the sums already in
    ``stats``.
    """
    goal = roi_target(stats, by)
    base = stats.groupBy(*by).agg(
        F.sum("review_count").alias("n"),
        F.sum(F.col("mean_sentiment") * F.col("review_count")).alias("total"),
    )
    shifted_neutral = maths.clip(F.col("sentiment_score") + (0.0 - F.col("target_mean")), -1.0, 1.0)
    shifted_positive = maths.clip(F.col("sentiment_score") + (F.lit(target) - F.col("target_mean")), -1.0, 1.0)
    # Equal scores are counted before the join, so a hot aspect brings a row per score and task, not its rows.
    counted = df.groupBy(*by, F.col("topic_label").alias("target_aspect"), "sentiment_score").agg(F.count(F.lit(1)).alias("_m"))
    touched = (
        counted
        .join(goal, [*by, "target_aspect"])
        .groupBy(*by)
        .agg(
            F.max("target_aspect").alias("target_aspect"),
            F.sum(F.col("sentiment_score") * F.col("_m")).alias("before"),
            F.sum(shifted_neutral * F.col("_m")).alias("neutral"),
            F.sum(shifted_positive * F.col("_m")).alias("positive"),
        )
    )
    baseline = F.col("total") / F.col("n")
    after_neutral = (F.col("total") - F.col("before") + F.col("neutral")) / F.col("n")
    after_positive = (F.col("total") - F.col("before") + F.col("positive")) / F.col("n")
    divisor = maths.safe_divisor(baseline)
    return base.join(touched, list(by)).select(
        *by,
        "target_aspect",
        baseline.alias("baseline_sentiment"),
        after_neutral.alias("sentiment_neutral"),
        after_positive.alias("sentiment_positive"),
        ((after_neutral - baseline) / divisor * 100).alias("improvement_pct_low"),
        ((after_positive - baseline) / divisor * 100).alias("improvement_pct_high"),
    )


def business_impact(df: DataFrame, by: Sequence[str] = PRODUCT) -> DataFrame:
    """Flagged reviews, invisible churn and revenue at risk, with the source of the money."""
    killers = F.count_if("is_silent_killer")
    if "revenue_at_risk" in df.columns:
        money, source = F.sum("revenue_at_risk"), "weighted (helpful votes + verified purchase)"
    else:
        money = killers * F.lit(fixed.CHURN_MULTIPLIER * fixed.AVERAGE_ORDER_VALUE)
        source = "naive fallback (no review weight)"
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        killers.alias("silent_killers"),
        (killers * fixed.CHURN_MULTIPLIER).alias("invisible_churn"),
        money.alias("revenue_at_risk"),
    ).withColumn("rar_source", F.lit(source))


def rar_by_aspect(df: DataFrame, by: Sequence[str] = PRODUCT) -> DataFrame:
    return df.filter("is_silent_killer").groupBy(*by, "topic_label").agg(
        F.sum("revenue_at_risk").alias("revenue_at_risk"), F.count(F.lit(1)).alias("silent_killers")
    )


def _top3_money(stats: DataFrame, impact: DataFrame, by: Sequence[str]) -> DataFrame:
    top = top_aspects(aspect_weights(stats, by), 3, by).select(*by, "topic_label", "rank_no", "weight")
    return top.join(impact.select(*by, "revenue_at_risk"), list(by))


def roi_calculator(stats: DataFrame, impact: DataFrame, by: Sequence[str] = PRODUCT, step: int = 5) -> DataFrame:
    """Recovered revenue for every fix percentage of the three most intense aspects."""
    pct = F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(step))).alias("fix_pct")
    return (
        _top3_money(stats, impact, by)
        .select("*", pct)
        .withColumn("recovered", F.col("revenue_at_risk") * F.col("fix_pct") / 100 * F.col("weight"))
    )


def recovery_grid(
    stats: DataFrame, impact: DataFrame, by: Sequence[str] = PRODUCT, percentages: Sequence[int] = (25, 50, 75, 100)
) -> DataFrame:
    pct = F.explode(F.array(*[F.lit(p) for p in percentages])).alias("fix_pct")
    return (
        _top3_money(stats, impact, by)
        .select("*", pct)
        .withColumn("recovered", F.col("revenue_at_risk") * F.col("fix_pct") / 100 * F.col("weight"))
    )


def hero_stats(all_reviews: DataFrame, impact: DataFrame, stats: DataFrame | None = None, by: Sequence[str] = PRODUCT) -> DataFrame:
    """Silent-killer share among 4 and 5 stars, revenue at risk and what three fixes recover.

    Without a priority matrix the recovery is 85% of the revenue at risk.
    """
    high = F.col("star_rating") >= 4
    share = all_reviews.groupBy(*by).agg(
        (F.count_if(high & F.col("is_silent_killer")) / F.greatest(F.count_if(high), F.lit(1)) * 100).alias("killer_pct_high_star")
    )
    out = share.join(impact.select(*by, "revenue_at_risk"), list(by), "left")
    money = F.coalesce("revenue_at_risk", F.lit(0.0))
    if stats is None:
        recovery = F.floor(money * 0.85)
    else:
        top3 = top_aspects(stats, 3, by).groupBy(*by).agg(F.sum("frequency_pct").alias("_top3"))
        total = stats.groupBy(*by).agg(F.greatest(F.sum("frequency_pct"), F.lit(1.0)).alias("_all"))
        out = out.join(top3.join(total, list(by)), list(by), "left")
        recovery = F.floor(money * F.coalesce(F.col("_top3") / F.col("_all"), F.lit(0.85)))
    return out.select(
        *by, F.round("killer_pct_high_star", 1).alias("killer_pct_high_star"), money.alias("revenue_at_risk"),
        recovery.cast("bigint").alias("recovery"),
    )
