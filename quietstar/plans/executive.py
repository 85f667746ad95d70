"""From labelled aspects to priorities, simulation, roadmap and one document per product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import aspects, strategy
from ..session import read_back
from ..sources import sinks

COLUMNS = (
    "product_id", "topic_id", "topic_label", "emo_anger", "emo_sadness", "emo_joy", "sentiment_score", "is_silent_killer",
    "revenue_at_risk",
)


def executive_summary(
    labelled: DataFrame, technical: Sequence[str] = fixed.TECHNICAL_ASPECTS,
    instructional: Sequence[str] = fixed.INSTRUCTIONAL_ASPECTS,
) -> DataFrame:
    """One nested row per product. Arrays hold a product's aspects, a handful of entries.

    The labelled rows feed four aggregations, so their few numeric columns are written once and the
    text is scored once.
    """
    needed = labelled.filter(F.col("review_date").isNotNull()).select(*COLUMNS)
    rows = read_back(labelled.sparkSession, aspects.drop_outliers(needed), "aspects")
    stats = aspects.aspect_stats(rows)
    matrix = strategy.priority_matrix(stats)
    plan = strategy.roadmap(matrix, technical=technical, instructional=instructional)
    impact = strategy.business_impact(rows)
    simulation = strategy.roi_simulation(rows, stats)

    matrix_docs = matrix.groupBy("product_id").agg(
        sinks.records([F.col("topic_label"), F.col("frequency_pct"), F.col("emotional_intensity"), F.col("quadrant")])
        .alias("priority_matrix")
    )
    plan_docs = plan.groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct("tier", "aspect", "quadrant", "intensity", "action"))).alias("_plan")
    ).select(
        "product_id",
        F.transform("_plan", lambda r: F.struct(
            r["aspect"].alias("aspect"), r["quadrant"].alias("quadrant"), r["intensity"].alias("intensity"),
            r["tier"].alias("tier"), r["action"].alias("action"),
        )).alias("strategic_roadmap"),
    )
    pitch = F.concat(
        F.lit("Mending "), F.col("target_aspect"), F.lit(": revenue at risk "), text.money(F.col("revenue_at_risk")),
        F.lit(", mean sentiment up by "),
        F.format_string("%.0f", F.round("improvement_pct_high", 0)), F.lit("%"),
    )
    display = F.create_map(*[F.lit(x) for pair in fixed.EMOTION_DISPLAY.items() for x in pair])
    return (
        impact.join(simulation, "product_id")
        .join(matrix_docs, "product_id")
        .join(plan_docs, "product_id")
        .select(
            "product_id",
            "total_reviews",
            F.struct(
                F.array(*[F.lit(e) for e in fixed.ACTIVE_EMOTIONS]).alias("active_signals"),
                display.alias("display_labels"),
                F.array(*[F.lit(e) for e in fixed.DISCARDED_EMOTIONS]).alias("discarded_signals"),
                F.lit("mean(emo_anger) + mean(emo_sadness)").alias("intensity_formula"),
            ).alias("emotion_model"),
            F.struct(
                "silent_killers",
                F.round("revenue_at_risk", 2).alias("revenue_at_risk_usd"),
                F.lit(fixed.AVERAGE_ORDER_VALUE).alias("aov_usd"),
                F.lit(fixed.CHURN_MULTIPLIER).alias("churn_multiplier"),
                "rar_source",
            ).alias("financials"),
            F.struct(
                "target_aspect",
                F.round("improvement_pct_low", 1).alias("improvement_pct_low"),
                F.round("improvement_pct_high", 1).alias("improvement_pct_high"),
                pitch.alias("slide_pitch"),
            ).alias("roi_simulation"),
            "priority_matrix",
            "strategic_roadmap",
        )
    )
