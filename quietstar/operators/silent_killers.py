"""High-star reviews whose words are negative, the bar they must clear and what they cost."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import fixed, maths, text
from . import ranking


def review_weight(df: DataFrame) -> DataFrame:
    boost = F.when(F.col("verified_purchase"), F.lit(fixed.VERIFIED_BOOST)).otherwise(1.0)
    return df.withColumn("sk_weight", (1 + F.log1p(F.col("helpful_votes"))) * boost)


def star_gap(df: DataFrame) -> DataFrame:
    return df.withColumn("star_normalized", (F.col("star_rating") - 3) / 2).withColumn(
        "star_gap", F.col("star_normalized") - F.col("sentiment_score")
    )


def sk_threshold(
    df: DataFrame, percentiles: Mapping[str, float] = fixed.REPORT_PERCENTILES, by: Sequence[str] = ()
) -> DataFrame:
    """Percentiles of ``prob_negative`` on confirmed-bad reviews; ``p10`` is the bar.

    Exact at any size: see :mod:`quietstar.operators.ranking`.
    """
    bad = df.filter(F.col("star_rating") <= fixed.CONFIRMED_BAD_MAX_STAR)
    return ranking.exact_percentiles(bad, list(by), "prob_negative", percentiles)


def threshold_value(df: DataFrame, percentile: float = fixed.KILLER_PERCENTILE) -> Column:
    """The bar over the whole frame as a scalar subquery."""
    return ranking.one_value(sk_threshold(df, {"threshold": percentile}), "threshold")


def pooled_threshold(
    frames: Sequence[DataFrame], percentile: float = fixed.KILLER_PERCENTILE,
    min_rows: int = fixed.POOLED_MIN_ROWS, default: float = fixed.POOLED_DEFAULT,
) -> DataFrame:
    """One bar over several frames; ``default`` when too few confirmed-bad reviews exist."""
    pooled = None
    for frame in frames:
        part = frame.select("star_rating", "prob_negative")
        pooled = part if pooled is None else pooled.unionByName(part)
    found = sk_threshold(pooled, {"threshold": percentile})
    # An aggregate without keys keeps the row when there is no confirmed-bad review at all.
    return found.agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.max(F.when(F.col("n_rows") >= min_rows, F.col("threshold"))), F.lit(default)).alias("threshold"),
    )


def is_killer(threshold: Column) -> Column:
    return F.coalesce(
        (F.col("star_rating") >= fixed.KILLER_MIN_STAR)
        & (F.col("prob_negative") > F.col("prob_positive"))
        & (F.col("prob_negative") >= threshold),
        F.lit(False),
    )


def flag_silent_killers(df: DataFrame, threshold: Column | float | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flag against a number, a scalar subquery or, with ``by``, a table of bars per key."""
    if isinstance(threshold, DataFrame):
        bars = threshold.select(*by, F.col("threshold").alias("_bar"))
        return df.join(bars, list(by), "left").withColumn("is_silent_killer", is_killer(F.col("_bar"))).drop("_bar")
    bar = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.withColumn("is_silent_killer", is_killer(bar))


def revenue_at_risk(
    df: DataFrame, order_value: float = fixed.AVERAGE_ORDER_VALUE, multiplier: float = fixed.CHURN_MULTIPLIER
) -> DataFrame:
    priced = F.lit(order_value * multiplier) * F.col("sk_weight")
    return df.withColumn("revenue_at_risk", F.when(F.col("is_silent_killer"), priced).otherwise(0.0))


def naive_revenue_at_risk(
    df: DataFrame, by: Sequence[str] = ("product_id",),
    order_value: float = fixed.AVERAGE_ORDER_VALUE, multiplier: float = fixed.CHURN_MULTIPLIER,
) -> DataFrame:
    """Count times order value, for tables without review weights."""
    return df.groupBy(*by).agg(F.count_if("is_silent_killer").alias("silent_killers")).withColumn(
        "revenue_at_risk", F.col("silent_killers") * F.lit(order_value * multiplier)
    )


def diagnose(df: DataFrame, threshold: Column | float | None = None) -> DataFrame:
    """Scored reviews to flagged, priced and gapped reviews; the bar comes from the same frame."""
    bar = threshold_value(df) if threshold is None else threshold
    return star_gap(revenue_at_risk(flag_silent_killers(review_weight(df), bar)))


def diagnostic_report(df: DataFrame, by: Sequence[str] = ("product_id",), extra: Sequence[Column] = ()) -> DataFrame:
    """Totals, means, flags and money per key; ``extra`` aggregates join the same pass."""
    n = F.count(F.lit(1))
    killers = F.count_if("is_silent_killer")
    return df.groupBy(*by).agg(
        n.alias("total_reviews"),
        F.avg("star_rating").alias("avg_star"),
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.avg("star_gap").alias("avg_star_gap"),
        killers.alias("silent_killers"),
        (killers / n * 100).alias("silent_killer_pct"),
        F.sum("revenue_at_risk").alias("revenue_at_risk"),
        *extra,
    )


def sanity_rates(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often extreme stars and the model agree, with a warning when they rarely do."""
    negative = (F.col("prob_negative") > F.col("prob_positive")).cast("double")
    positive = (F.col("prob_positive") > F.col("prob_negative")).cast("double")
    return (
        df.groupBy(*by)
        .agg(
            F.avg(F.when(F.col("star_rating") == 1, negative)).alias("one_star_negative_rate"),
            F.avg(F.when(F.col("star_rating") == 5, positive)).alias("five_star_positive_rate"),
        )
        .withColumn(
            "low_agreement",
            F.coalesce(
                (F.col("one_star_negative_rate") < 0.5) | (F.col("five_star_positive_rate") < 0.6), F.lit(False)
            ),
        )
    )


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return front * h


@F.pandas_udf(DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation from Student's t; one value per group, not per row."""

    def one(rv: float, nv: float) -> float:
        if rv is None or not np.isfinite(rv) or nv < 3:
            return float("nan")
        if abs(rv) >= 1.0:
            return 0.0
        dof = nv - 2
        t2 = rv * rv * dof / (1 - rv * rv)
        return _beta_tail(dof / 2, 0.5, dof / (dof + t2))

    return pd.Series([one(a, b) for a, b in zip(r, n)])


def star_sentiment_corr(df: DataFrame, by: Sequence[str] = (), with_p: bool = False) -> DataFrame:
    r = maths.pearson((F.col("star_rating") - 3) / 2, F.col("sentiment_score"))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r.alias("pearson_r"))
    out = out.withColumn("weak_correlation", F.coalesce(F.col("pearson_r") < 0.5, F.lit(False)))
    return out.withColumn("p_value", pearson_p("pearson_r", "n")) if with_p else out


def top_silent_killers(df: DataFrame, n: int = 5) -> DataFrame:
    return (
        df.filter("is_silent_killer")
        .orderBy(F.desc("revenue_at_risk"), F.asc("review_id"))
        .limit(n)
        .select(
            "review_id", "product_id", "star_rating", "prob_negative", "helpful_votes", "sk_weight",
            "revenue_at_risk", F.replace(text.truncate(F.col("review_text"), 120), F.lit("\n"), F.lit(" ")).alias("snippet"),
        )
    )


VALIDATION_COLUMNS = (
    "review_text", "star_rating", "prob_negative", "prob_positive", "prob_neutral", "helpful_votes",
    "verified_purchase", "sk_weight", "revenue_at_risk", "star_gap", "is_silent_killer",
)


def validation_sample(df: DataFrame, n: int = 50) -> DataFrame:
    """The costliest flagged reviews with a blank column for hand labels."""
    return (
        df.filter("is_silent_killer")
        .orderBy(F.desc("revenue_at_risk"), F.asc("review_id"))
        .limit(n)
        .select("review_id", *VALIDATION_COLUMNS, F.lit("").alias("manually_correct"))
    )


def validation_precision(df: DataFrame, label: str = "manually_correct") -> DataFrame:
    """Share of hand-labelled rows judged correct; blank labels count as not correct."""
    correct = F.coalesce(F.col(label).cast("string").try_cast("boolean"), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("precision"))
