"""Which products hide unhappy customers behind high stars, and what that costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths
from ..operators import silent_killers as sk


def silent_killer_diagnosis(scored: DataFrame, threshold: Column | float | None = None) -> DataFrame:
    """Per-product report, costliest first, with the correlation of stars and score."""
    correlation = maths.pearson(F.col("star_normalized"), F.col("sentiment_score")).alias("pearson_r")
    report = sk.diagnostic_report(sk.diagnose(scored, threshold), extra=[correlation])
    return report.orderBy(F.desc("revenue_at_risk"), F.asc("product_id"))
