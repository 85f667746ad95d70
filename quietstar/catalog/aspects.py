"""Aspects, heatmaps, priorities, simulations, drill-down and the executive summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import aspects, drilldown, strategy
from ..plans import executive, topics
from ..sources import adapters as A
from .common import labelled, labelled_stage, rounded, stats, topical, topical_stage
from .sql import CLEAN, query, rnd, words


def _per_product(spark, sf, build):
    """``build(stats, impact)`` over labelled rows that are scored once."""
    rows = topical_stage(spark, sf)
    return build(aspects.aspect_stats(rows), strategy.business_impact(rows))


def _roadmap(spark, sf):
    return rounded(strategy.roadmap(
        strategy.priority_matrix(stats(spark, sf)), technical=A.TECHNICAL, instructional=A.INSTRUCTIONAL
    ), 3)


def _roi(spark, sf):
    rows = topical_stage(spark, sf)
    return rounded(strategy.roi_simulation(rows, aspects.aspect_stats(rows)))


def _hero(spark, sf):
    everything = labelled_stage(spark, sf)
    rows = aspects.drop_outliers(everything)
    return rounded(strategy.hero_stats(everything, strategy.business_impact(rows), aspects.aspect_stats(rows)), 2)


def _drill(spark, sf):
    rows = drilldown.drilldown(topical(spark, sf), stars=[5], aspects=["Alpha", "Beta"], first="2021-03-01", last="2022-06-30")
    return rounded(drilldown.ordered(rows).select("review_id", "star_rating", "topic_label", dates.iso_day(F.col("review_date")).alias("day"), "star_gap"))


def _weights(spark, sf, bigrams=False):
    rows = aspects.drop_outliers(aspects.keyword_aspects(aspects.with_clean_text(A.reviews(spark, sf)), A.ASPECTS))
    return aspects.class_tfidf(rows, bigrams=bigrams, stop_words=[])


def _topic_labels(spark, sf):
    """Topics named after the rule that shares most of their heaviest terms."""
    top = aspects.top_terms(_weights(spark, sf), 10)
    ids = F.coalesce(*[F.when(F.col("topic_label") == n, F.lit(i)) for i, (n, _) in enumerate(A.ASPECTS)])
    rules = [(n, w) for n, w in A.ASPECTS if n != "Gamma"]
    return aspects.label_topics(
        top.select(ids.cast("bigint").alias("topic_id"), "term", "rank_no"), rules, {"Aspect 3": "Third aspect"}
    )


def _topics(spark, sf):
    _, assigned = aspects.fit_topics(aspects.with_clean_text(A.reviews(spark, sf)).select("review_id", "clean_text"), k=5)
    return assigned.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))


def _texts(spark, sf):
    return aspects.with_clean_text(A.reviews(spark, sf)).select("product_id", "review_id", "clean_text")


def _purity(spark, sf):
    vectors = A.table(spark, sf, "embeddings")
    return aspects.cluster_purity(aspects.cluster_vectors(vectors, "embedding", k=10, min_size=20), "topic_id", "label")


def _projection(spark, sf):
    rows = aspects.with_clean_text(A.reviews(spark, sf))
    return aspects.project_2d(rows).select("review_id", "x", "y")


def _quotes(spark, sf):
    rows = labelled(spark, sf).filter("topic_id <> -1").withColumn("clean_text", F.col("review_text"))
    return aspects.representative_quotes(rows).select("product_id", "topic_label", "quote_rank", "review_id", "quote_text")


QUERIES = {
    "keyword_aspects": lambda s, d: aspects.keyword_aspects(A.reviews(s, d), A.ASPECTS).select("review_id", "topic_id", "topic_label"),
    "drop_outlier_topics": lambda s, d: aspects.drop_outliers(aspects.keyword_aspects(A.reviews(s, d), A.ASPECTS))
        .groupBy("topic_label").agg(F.count(F.lit(1)).alias("n")),
    "aspect_stats": lambda s, d: rounded(stats(s, d)),
    "aspect_weights": lambda s, d: rounded(strategy.aspect_weights(stats(s, d)).select("product_id", "topic_label", "weight")),
    "top_aspects": lambda s, d: rounded(strategy.top_aspects(stats(s, d)).select(
        "product_id", "rank_no", "topic_label", "emotional_intensity"
    )),
    "emotion_heatmap": lambda s, d: rounded(aspects.emotion_heatmap(topical(s, d))),
    "urgency_heatmap": lambda s, d: rounded(aspects.urgency_heatmap(topical(s, d)), 4),
    "priority_matrix": lambda s, d: rounded(strategy.priority_matrix(stats(s, d)).select(
        "product_id", "topic_label", "frequency_pct", "emotional_intensity", "quadrant"
    )),
    "strategic_roadmap": _roadmap,
    "roi_target": lambda s, d: rounded(strategy.roi_target(stats(s, d))),
    "roi_simulation": _roi,
    "roi_calculator": lambda s, d: rounded(_per_product(s, d, strategy.roi_calculator).select(
        "product_id", "topic_label", "fix_pct", "recovered"
    ), 2),
    "recovery_grid": lambda s, d: rounded(_per_product(s, d, strategy.recovery_grid).select(
        "product_id", "topic_label", "fix_pct", "recovered"
    ), 2),
    "business_impact": lambda s, d: rounded(strategy.business_impact(topical(s, d)), 2),
    "rar_by_aspect": lambda s, d: rounded(strategy.rar_by_aspect(topical(s, d)), 2),
    "hero_stats": _hero,
    "silent_killer_drilldown": _drill,
    "drilldown_display": lambda s, d: drilldown.drilldown_view(drilldown.drilldown(topical(s, d))),
    "class_tfidf": lambda s, d: rounded(_weights(s, d, bigrams=True)),
    "topic_terms": lambda s, d: rounded(aspects.top_terms(_weights(s, d), 10)),
    "topic_labels": _topic_labels,
    "topic_clusters": _topics,
    "product_topics": lambda s, d: rounded(topics.product_topics(_texts(s, d))),
    "discovered_topics": lambda s, d: rounded(topics.discovered_topics(_texts(s, d), rules=A.ASPECTS)),
    "cluster_purity": _purity,
    "cluster_projection": _projection,
    "representative_quotes": _quotes,
    "executive_summary": lambda s, d: executive.executive_summary(labelled(s, d), A.TECHNICAL, A.INSTRUCTIONAL).select(
        "product_id", "total_reviews", "financials.silent_killers",
        F.round("financials.revenue_at_risk_usd", 2).alias("revenue_at_risk"),
        "roi_simulation.target_aspect", "roi_simulation.improvement_pct_low", "roi_simulation.improvement_pct_high",
        "roi_simulation.slide_pitch", F.size("priority_matrix").cast("bigint").alias("n_aspects"),
        F.array_join(F.transform("strategic_roadmap", lambda r: F.concat_ws("/", r["aspect"], r["quadrant"], r["action"])), "; ").alias("roadmap"),
    ),
}

_ACTION = f"""CASE WHEN emotional_intensity >= 0.40 * 1.5
    THEN CASE WHEN topic_label IN ({words(A.TECHNICAL)}) THEN 'Firmware / Engineering Fix' ELSE 'Urgent Quality Review' END
  WHEN emotional_intensity < 0.40 * 0.67
    THEN CASE WHEN topic_label IN ({words(A.INSTRUCTIONAL)}) THEN 'Marketing Campaign / Tutorial Content' ELSE 'UX / Design Improvement' END
  ELSE 'Engineering Review' END"""
_TIER = "CASE WHEN emotional_intensity >= 0.40 * 1.5 THEN 'Short-Term (0-3 months)' ELSE 'Mid-Term (3-6 months)' END"
_ROI = {
    "target": """SELECT product_id, topic_label AS target_aspect, mean_anger, mean_sentiment AS target_mean FROM stats
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY round(mean_anger, 9) DESC, topic_label) = 1""",
    "simulated": """
        SELECT product_id, any_value(target_aspect) AS target_aspect, avg(sentiment_score) AS base,
          avg(CASE WHEN hit THEN greatest(least(sentiment_score - target_mean, 1), -1) ELSE sentiment_score END) AS neutral,
          avg(CASE WHEN hit THEN greatest(least(sentiment_score + 0.5::double - target_mean, 1), -1) ELSE sentiment_score END) AS positive
        FROM (SELECT *, topic_label = target_aspect AS hit FROM topical JOIN target USING (product_id)) GROUP BY ALL""",
    "roi": """
        SELECT *, (neutral - base) / d * 100 AS low, (positive - base) / d * 100 AS high
        FROM (SELECT *, CASE WHEN abs(base) > 0.001 THEN abs(base) ELSE 1 END AS d FROM simulated)""",
}
_TOP3_MONEY = "(SELECT * FROM ranked_aspects WHERE rank_no <= 3) JOIN impact USING (product_id)"
_TERMS = {
    "kept_words": f"""
        SELECT topic_label, string_split({CLEAN}, ' ') AS w FROM (
          SELECT * FROM aspected WHERE topic_id <> -1 AND len(regexp_extract_all({CLEAN}, '[^ ]+')) >= 5)""",
    "terms": "SELECT topic_label, unnest(w) AS term FROM kept_words",
    "terms_and_pairs": """
        SELECT * FROM terms UNION ALL
        SELECT topic_label, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM kept_words""",
}


def _tfidf(source: str) -> str:
    return f"""
        SELECT topic_label, term, tf, sqrt(tf / size) * ln(1 + (SELECT avg(size) FROM (SELECT count(*) AS size FROM {source} GROUP BY topic_label)) / f) AS weight
        FROM (SELECT topic_label, term, count(*) AS tf FROM {source} GROUP BY ALL)
        JOIN (SELECT topic_label, count(*) AS size FROM {source} GROUP BY ALL) USING (topic_label)
        JOIN (SELECT term, count(*) AS f FROM {source} GROUP BY ALL) USING (term)"""


_TERM_RANKS = _TERMS | {
    "weights": _tfidf("terms"),
    "term_ranks": "SELECT *, row_number() OVER (PARTITION BY topic_label ORDER BY round(weight, 9) DESC, term) AS rank_no FROM weights",
}

ORACLES = {
    "keyword_aspects": query("SELECT review_id, topic_id, topic_label FROM aspected"),
    "drop_outlier_topics": query("SELECT topic_label, count(*) AS n FROM aspected WHERE topic_id <> -1 GROUP BY ALL"),
    "aspect_stats": query("SELECT product_id, topic_label, review_count, " + ", ".join(rnd(c, c) for c in (
        "mean_anger", "mean_disapp", "mean_joy", "mean_sentiment", "frequency_pct", "emotional_intensity")) + " FROM stats"),
    "aspect_weights": query(f"SELECT product_id, topic_label, {rnd('weight', 'weight')} FROM ranked_aspects"),
    "top_aspects": query(f"""
        SELECT product_id, rank_no, topic_label, {rnd("emotional_intensity", "emotional_intensity")} FROM ranked_aspects WHERE rank_no <= 3"""),
    "emotion_heatmap": query("SELECT product_id, topic_label, " + ", ".join(
        rnd(f"count_if(dominant_emotion_display = '{e}') * 100.0::double / count(*)", e.lower()) for e in ("Anger", "Disappointment", "Joy")
    ) + " FROM topical GROUP BY ALL"),
    "urgency_heatmap": query("""
        SELECT product_id, topic_label, round(mean_anger * 100, 4) AS anger, round(mean_disapp * 100, 4) AS disappointment,
          round(mean_joy * 100, 4) AS joy,
          row_number() OVER (PARTITION BY product_id ORDER BY round(mean_anger * 100, 9) DESC, topic_label) = 1 AS is_worst FROM stats"""),
    "priority_matrix": query(f"""
        SELECT product_id, topic_label, {rnd("frequency_pct", "frequency_pct")}, {rnd("emotional_intensity", "emotional_intensity")},
          quadrant FROM matrix"""),
    "strategic_roadmap": query(f"""
        SELECT product_id, topic_label AS aspect, quadrant, round(emotional_intensity, 3) AS intensity, {_TIER} AS tier, {_ACTION} AS action
        FROM matrix"""),
    "roi_target": query(f"""
        SELECT product_id, target_aspect, {rnd("mean_anger", "mean_anger")}, {rnd("target_mean", "target_mean")} FROM target""", **_ROI),
    "roi_simulation": query(f"""
        SELECT product_id, target_aspect, {rnd("base", "baseline_sentiment")}, {rnd("neutral", "sentiment_neutral")},
          {rnd("positive", "sentiment_positive")}, {rnd("low", "improvement_pct_low")}, {rnd("high", "improvement_pct_high")} FROM roi""", **_ROI),
    "roi_calculator": query(f"""
        SELECT product_id, topic_label, fix_pct::int AS fix_pct, round(revenue_at_risk * fix_pct / 100 * weight, 2) AS recovered
        FROM {_TOP3_MONEY}, (SELECT unnest(generate_series(0, 100, 5)) AS fix_pct)"""),
    "recovery_grid": query(f"""
        SELECT product_id, topic_label, fix_pct::int AS fix_pct, round(revenue_at_risk * fix_pct / 100 * weight, 2) AS recovered
        FROM {_TOP3_MONEY}, (SELECT unnest([25, 50, 75, 100]) AS fix_pct)"""),
    "business_impact": query("""
        SELECT product_id, total_reviews, silent_killers, invisible_churn, round(revenue_at_risk, 2) AS revenue_at_risk,
          'weighted (helpful votes + verified purchase)' AS rar_source FROM impact"""),
    "rar_by_aspect": query("""
        SELECT product_id, topic_label, round(sum(revenue_at_risk), 2) AS revenue_at_risk, count(*) AS silent_killers
        FROM topical WHERE is_silent_killer GROUP BY ALL"""),
    "hero_stats": query("""
        SELECT product_id, killer_pct_high_star, round(coalesce(revenue_at_risk, 0), 2) AS revenue_at_risk,
          floor(coalesce(revenue_at_risk, 0) * coalesce(share, 0.85))::bigint AS recovery
        FROM (SELECT product_id, round(count_if(star_rating >= 4 AND is_silent_killer) * 100.0::double / greatest(count_if(star_rating >= 4), 1), 1)
                AS killer_pct_high_star FROM labelled GROUP BY ALL)
        LEFT JOIN impact USING (product_id)
        LEFT JOIN (SELECT product_id, sum(frequency_pct) FILTER (rank_no <= 3) / greatest(sum(frequency_pct), 1) AS share
                   FROM ranked_aspects GROUP BY ALL) USING (product_id)"""),
    "silent_killer_drilldown": query(f"""
        SELECT review_id, star_rating, topic_label, strftime(review_date, '%Y-%m-%d') AS day, {rnd("star_gap", "star_gap")}
        FROM topical WHERE is_silent_killer AND star_rating = 5 AND topic_label IN ('Alpha', 'Beta')
          AND review_date BETWEEN '2021-03-01' AND '2022-06-30'"""),
    "drilldown_display": query("""
        SELECT review_id, strftime(review_date, '%Y-%m-%d') AS date, star_rating AS stars, round(sentiment_score, 3) + 0 AS sentiment,
          round(topical.star_gap, 3) + 0 AS star_gap, topic_label AS aspect, substr(review_text, 1, 120) || '...' AS review_snippet,
          '$' || format('{:,}', round(topical.revenue_at_risk)::bigint) AS revenue_at_risk FROM topical WHERE is_silent_killer"""),
    "class_tfidf": query(f"SELECT topic_label, term, tf, {rnd('weight', 'weight')} FROM weights",
                         **_TERMS, weights=_tfidf("terms_and_pairs")),
    "topic_terms": query(f"SELECT topic_label, term, tf, {rnd('weight', 'weight')}, rank_no FROM term_ranks WHERE rank_no <= 10", **_TERM_RANKS),
    "topic_labels": query(f"""
        SELECT topic_id, CASE WHEN a = 0 AND b = 0 THEN CASE WHEN topic_id = 2 THEN 'Third aspect' ELSE 'Aspect ' || (topic_id + 1)::varchar END
            WHEN a >= b THEN 'Alpha' ELSE 'Beta' END AS topic_label, greatest(a, b) AS overlap
        FROM (SELECT CASE topic_label WHEN 'Alpha' THEN 0 WHEN 'Beta' THEN 1 ELSE 2 END::bigint AS topic_id,
                count(DISTINCT term) FILTER (term IN ({words(A.ASPECTS[0][1])})) AS a,
                count(DISTINCT term) FILTER (term IN ({words(A.ASPECTS[1][1])})) AS b
              FROM term_ranks WHERE rank_no <= 10 GROUP BY topic_label)""", **_TERM_RANKS),
    "executive_summary": query(f"""
        SELECT product_id, total_reviews, silent_killers, round(impact.revenue_at_risk, 2) AS revenue_at_risk, target_aspect,
          round(low, 1) + 0 AS improvement_pct_low, round(high, 1) + 0 AS improvement_pct_high,
          'Mending ' || target_aspect || ': revenue at risk $' || format('{{:,}}', round(impact.revenue_at_risk)::bigint)
            || ', mean sentiment up by ' || printf('%.0f', round(high) + 0) || '%' AS slide_pitch, n_aspects, roadmap
        FROM impact JOIN roi USING (product_id)
        JOIN (SELECT product_id, count(*) AS n_aspects,
                string_agg(topic_label || '/' || quadrant || '/' || {_ACTION}, '; ' ORDER BY {_TIER}, topic_label) AS roadmap
              FROM matrix GROUP BY ALL) USING (product_id)""", **_ROI),
}
