"""Rule expressions that turn scores into labels and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def tone(score: Column) -> Column:
    return F.when(score < -0.1, "negative").when(score > 0.1, "positive").otherwise("mixed/neutral")


def segment(star: Column, score: Column) -> Column:
    return (
        F.when((star >= 4) & (score < 0), "Silent Killers")
        .when((star >= 4) & (score >= 0.5), "Loyalists")
        .when((star <= 2) & (score < 0), "Vocal Detractors")
        .when((star == 3) & (score < 0), "At Risk")
        .otherwise("Other")
    )


def quadrant(
    frequency_pct: Column,
    intensity: Column,
    frequency_bar: float = fixed.FREQUENCY_THRESHOLD,
    intensity_bar: float = fixed.INTENSITY_THRESHOLD,
) -> Column:
    often, strong = frequency_pct >= frequency_bar, intensity >= intensity_bar
    return (
        F.when(often & strong, "Urgent Redesign")
        .when(strong, "Quality Control Edge Case")
        .when(often, "Marketing / Expectation Issue")
        .otherwise("Monitor Only")
    )


def roadmap_tier(intensity: Column, bar: float = fixed.INTENSITY_THRESHOLD) -> Column:
    return F.when(intensity >= bar * 1.5, "Short-Term (0-3 months)").otherwise("Mid-Term (3-6 months)")


def roadmap_action(
    aspect: Column,
    intensity: Column,
    bar: float = fixed.INTENSITY_THRESHOLD,
    technical=fixed.TECHNICAL_ASPECTS,
    instructional=fixed.INSTRUCTIONAL_ASPECTS,
) -> Column:
    return (
        F.when(
            intensity >= bar * 1.5,
            F.when(aspect.isin(*technical), "Firmware / Engineering Fix").otherwise("Urgent Quality Review"),
        )
        .when(
            intensity < bar * 0.67,
            F.when(aspect.isin(*instructional), "Marketing Campaign / Tutorial Content")
            .otherwise("UX / Design Improvement"),
        )
        .otherwise("Engineering Review")
    )


def known(value: Column) -> Column:
    """Null for every spelling of missing: null, NaN text, blank and "Unknown"."""
    text = F.trim(value)
    return F.when(text.isin("", "Unknown", "nan", "NaN"), F.lit(None)).otherwise(value)


def display_name(brand: Column, title: Column) -> Column:
    b, t = known(brand), F.nullif(F.trim(F.coalesce(title, F.lit(""))), F.lit(""))
    return (
        F.when(b.isNotNull() & t.isNotNull(), F.concat(b, F.lit(" "), t))
        .when(b.isNotNull(), F.concat(b, F.lit(" product")))
        .otherwise("the flagship product")
    )


def leaf_category(categories: Column, main_category: Column, default: str = "Electronics") -> Column:
    leaf = F.when(F.size(categories) > 0, F.nullif(F.element_at(categories, -1), F.lit("")))
    return F.coalesce(leaf, main_category, F.lit(default))


def scores_to_map(scores: Column) -> Column:
    """``array<struct<label, score>>`` in any order and case to a lower-case map."""
    return F.map_from_entries(
        F.transform(scores, lambda s: F.struct(F.lower(s["label"]).alias("key"), s["score"].alias("value")))
    )


def score_for(scores: Column, part: str) -> Column:
    """Score of the first label that contains ``part``."""
    hits = F.filter(scores, lambda s: F.lower(s["label"]).contains(part))
    return F.when(F.size(hits) > 0, F.element_at(hits, 1)["score"])
