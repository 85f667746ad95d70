"""Tables behind the review drill-down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text


def drilldown(
    df: DataFrame, stars: Sequence[float] = (), aspects: Sequence[str] = (), first: str | None = None, last: str | None = None
) -> DataFrame:
    """Flagged reviews of the chosen stars, aspects and inclusive dates; an empty choice keeps all."""
    out = df.filter("is_silent_killer")
    if stars:
        out = out.filter(F.col("star_rating").isin(*[float(s) for s in stars]))
    if aspects:
        out = out.filter(F.col("topic_label").isin(*aspects))
    if first is not None:
        out = out.filter(F.col("review_date") >= F.to_date(F.lit(first)))
    if last is not None:
        out = out.filter(F.col("review_date") <= F.to_date(F.lit(last)))
    return out


def ordered(df: DataFrame) -> DataFrame:
    """Smallest star gap first, or lowest score where there is no gap column."""
    key = "star_gap" if "star_gap" in df.columns else "sentiment_score"
    return df.orderBy(F.asc(key), F.asc("review_id"))


def drilldown_view(df: DataFrame) -> DataFrame:
    return df.select(
        "review_id",
        dates.iso_day(F.col("review_date")).alias("date"),
        F.col("star_rating").alias("stars"),
        F.round("sentiment_score", 3).alias("sentiment"),
        F.round("star_gap", 3).alias("star_gap"),
        F.col("topic_label").alias("aspect"),
        text.snippet(F.col("review_text"), 120).alias("review_snippet"),
        text.money(F.col("revenue_at_risk")).alias("revenue_at_risk"),
    )
