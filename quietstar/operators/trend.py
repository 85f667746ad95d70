"""Monthly drift: metrics, smoothing, deltas and changepoints.

Windows here run over the months of a product, after aggregation: a few hundred rows per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, maths

PRODUCT = ("product_id",)


def _months(by: Sequence[str]):
    keys = [F.col(c) for c in by] or [F.lit(0)]
    return W.partitionBy(*keys).orderBy("month")


def monthly_metrics(df: DataFrame, min_reviews: int = 3, by: Sequence[str] = PRODUCT) -> DataFrame:
    """Monthly means and silent-killer rate; months below ``min_reviews`` are dropped.

    Emotion columns are used when present.
    """
    means = [F.avg("sentiment_score").alias("mean_sentiment")]
    emotions = {"emo_anger": "mean_anger", "emo_sadness": "mean_sadness"}
    present = [c for c in emotions if c in df.columns]
    means += [F.avg(c).alias(emotions[c]) for c in present]
    out = (
        df.filter(F.col("review_date").isNotNull())
        .groupBy(*by, dates.month_end(F.col("review_date")).alias("month"))
        .agg(
            F.count("sentiment_score").alias("review_count"),
            F.count_if("is_silent_killer").alias("sk_count"),
            *means,
        )
        .filter(F.col("review_count") >= min_reviews)
        .withColumn("sk_rate", maths.clip(F.col("sk_count") / F.col("review_count") * 100, 0.0, 100.0))
    )
    if len(present) == 2:
        out = out.withColumn("urgency", F.col("mean_anger") + F.col("mean_sadness"))
    return out


def monthly_sk_join(df: DataFrame, min_reviews: int = 10, by: Sequence[str] = PRODUCT) -> DataFrame:
    """Month grid with flagged counts, zero where a month has none.

    The flagged counts come from the same pass as conditional counts: no second scan, no join.
    """
    return monthly_metrics(df.select(*by, "review_date", "sentiment_score", "is_silent_killer"), min_reviews, by)


def rolling_mean(column: str, width: int, min_rows: int, by: Sequence[str] = PRODUCT) -> Column:
    """Centred mean over surviving months, null where fewer than ``min_rows`` are in the frame."""
    half = width // 2
    frame = _months(by).rowsBetween(-half, half)
    return F.when(F.count(column).over(frame) >= min_rows, F.avg(column).over(frame))


def smooth(monthly: DataFrame, width: int = 5, min_rows: int = 2, by: Sequence[str] = PRODUCT) -> DataFrame:
    return monthly.withColumn("smooth_sentiment", rolling_mean("mean_sentiment", width, min_rows, by)).withColumn(
        "smooth_sk_rate", rolling_mean("sk_rate", width, min_rows, by)
    )


def delta(monthly: DataFrame, column: str = "smooth_sentiment", by: Sequence[str] = PRODUCT) -> DataFrame:
    """Difference to the previous surviving month."""
    return monthly.withColumn("sentiment_delta", F.col(column) - F.lag(column).over(_months(by)))


def changepoint(monthly: DataFrame, min_reviews: int = 5, by: Sequence[str] = PRODUCT) -> DataFrame:
    """The month with the steepest fall among well-populated months, or among all if there are none.

    Expects ``sentiment_delta``, computed before the volume filter; the earliest month wins ties.
    """
    keys = [F.col(c) for c in by] or [F.lit(0)]
    stable = F.col("review_count") >= min_reviews
    steepest = W.partitionBy(*keys).orderBy(F.asc(F.round("sentiment_delta", 9)), F.asc("month"))
    return (
        monthly.withColumn("_stable", stable)
        .withColumn("_any_stable", F.max("_stable").over(W.partitionBy(*keys)))
        .filter((F.col("_stable") == F.col("_any_stable")) & F.col("sentiment_delta").isNotNull())
        .withColumn("_n", F.row_number().over(steepest))
        .filter("_n = 1")
        .select(*by, F.col("month").alias("changepoint_month"), F.abs("sentiment_delta").alias("drop"))
    )


def temporal_trend(df: DataFrame, by: Sequence[str] = PRODUCT, min_reviews: int = 3) -> DataFrame:
    """Monthly series with smoothing and deltas, the changepoint month marked."""
    series = delta(smooth(monthly_metrics(df, min_reviews, by), by=by), by=by)
    keys = [F.col(c) for c in by] or [F.lit(0)]
    stable = F.col("review_count") >= 5
    eligible = (stable == F.max(stable).over(W.partitionBy(*keys))) & F.col("sentiment_delta").isNotNull()
    marked = series.withColumn("_eligible", eligible)
    order = W.partitionBy(*keys).orderBy(F.desc("_eligible"), F.asc(F.round("sentiment_delta", 9)), F.asc("month"))
    return marked.withColumn("is_changepoint", (F.row_number().over(order) == 1) & F.col("_eligible")).drop("_eligible")
