"""Explicit schemas of the tables that flow between stages."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEWS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("review_summary", T.StringType()),
    T.StructField("star_rating", T.DoubleType()),
    T.StructField("unix_time", T.LongType()),
    T.StructField("review_date", T.DateType()),
    T.StructField("helpful_votes", T.LongType()),
    T.StructField("verified_purchase", T.BooleanType()),
])

METADATA = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("category", T.StringType()),
])

SUMMARY = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("total_reviews", T.LongType()),
    T.StructField("emotion_model", T.StructType([
        T.StructField("active_signals", T.ArrayType(T.StringType())),
        T.StructField("display_labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("discarded_signals", T.ArrayType(T.StringType())),
        T.StructField("intensity_formula", T.StringType()),
    ])),
    T.StructField("financials", T.StructType([
        T.StructField("silent_killers", T.LongType()),
        T.StructField("revenue_at_risk_usd", T.DoubleType()),
        T.StructField("aov_usd", T.DoubleType()),
        T.StructField("churn_multiplier", T.IntegerType()),
        T.StructField("rar_source", T.StringType()),
    ])),
    T.StructField("roi_simulation", T.StructType([
        T.StructField("target_aspect", T.StringType()),
        T.StructField("improvement_pct_low", T.DoubleType()),
        T.StructField("improvement_pct_high", T.DoubleType()),
        T.StructField("slide_pitch", T.StringType()),
    ])),
    T.StructField("priority_matrix", T.ArrayType(T.StructType([
        T.StructField("topic_label", T.StringType()),
        T.StructField("frequency_pct", T.DoubleType()),
        T.StructField("emotional_intensity", T.DoubleType()),
        T.StructField("quadrant", T.StringType()),
    ]))),
    T.StructField("strategic_roadmap", T.ArrayType(T.StructType([
        T.StructField("aspect", T.StringType()),
        T.StructField("quadrant", T.StringType()),
        T.StructField("intensity", T.DoubleType()),
        T.StructField("tier", T.StringType()),
        T.StructField("action", T.StringType()),
    ]))),
])
