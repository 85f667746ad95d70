"""Weights, flags, thresholds, money and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, labels
from ..operators import discovery, quality, sampling, silent_killers as sk, strategy
from ..plans import diagnosis
from ..sources import adapters as A
from .common import flagged, lines, lines_flagged, rounded, scored
from .sql import query, rnd


def _percentiles(view: str, where: str = "") -> str:
    cols = ", ".join(rnd(f"quantile_cont(prob_negative, {p})", n) for n, p in fixed.REPORT_PERCENTILES.items())
    return f"SELECT count(*) AS n_rows, {cols} FROM {view} WHERE star_rating <= 2 {where}"


def _pooled(spark, sf):
    return rounded(sk.pooled_threshold([scored(spark, sf), lines(spark, sf)]))


def _validated(spark, sf):
    """Hand labels stand-in: the labels table joined to the flagged reviews it covers."""
    marks = A.table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"), F.col("quality").cast("string").alias("manually_correct"))
    return rounded(sk.validation_precision(flagged(spark, sf).filter("is_silent_killer").join(marks, "review_id")))


QUERIES = {
    "review_weight": lambda s, d: rounded(
        sk.review_weight(A.reviews(s, d)).select("review_id", "helpful_votes", "verified_purchase", "sk_weight")
    ),
    "sentiment_score": lambda s, d: rounded(lines(s, d).groupBy("product_id").agg(
        F.avg("sentiment_score").alias("avg_score"), F.min("sentiment_score").alias("min_score"),
        F.max("sentiment_score").alias("max_score"),
    )),
    "star_gap": lambda s, d: rounded(
        sk.star_gap(scored(s, d)).select("review_id", "star_normalized", "sentiment_score", "star_gap")
    ),
    "silent_killers": lambda s, d: rounded(flagged(s, d).select(
        "review_id", "product_id", "star_rating", "prob_negative", "prob_positive", "is_silent_killer"
    )),
    "revenue_at_risk": lambda s, d: rounded(lines_flagged(s, d).groupBy("product_id").agg(
        F.count_if("is_silent_killer").alias("silent_killers"), F.sum("revenue_at_risk").alias("revenue_at_risk")
    ), 2),
    "revenue_at_risk_naive": lambda s, d: rounded(sk.naive_revenue_at_risk(lines_flagged(s, d)), 2),
    "sk_threshold": lambda s, d: rounded(sk.sk_threshold(lines(s, d))),
    "sk_threshold_by_product": lambda s, d: rounded(sk.sk_threshold(lines(s, d), by=["product_id"])),
    "pooled_sk_threshold": _pooled,
    "diagnostic_report": lambda s, d: rounded(sk.diagnostic_report(lines_flagged(s, d)), 4),
    "model_sanity": lambda s, d: rounded(sk.sanity_rates(scored(s, d), ["product_id"])),
    "star_sentiment_corr": lambda s, d: rounded(sk.star_sentiment_corr(lines(s, d))),
    "star_sentiment_p_value": lambda s, d: rounded(sk.star_sentiment_corr(lines(s, d), ["product_id"], with_p=True)),
    "top_silent_killers": lambda s, d: rounded(sk.top_silent_killers(flagged(s, d))),
    "validation_sample": lambda s, d: rounded(sk.validation_sample(flagged(s, d))),
    "validation_precision": _validated,
    "customer_segments": lambda s, d: strategy.customer_segments(scored(s, d)).select(
        "review_id", "star_rating", F.round("sentiment_score", 6).alias("sentiment_score"), "segment"
    ),
    "segment_counts": lambda s, d: quality.value_counts(strategy.customer_segments(lines(s, d)), "segment"),
    "tone_label": lambda s, d: lines(s, d).withColumn("tone", labels.tone(F.col("sentiment_score")))
        .groupBy("product_id", "tone").agg(F.count(F.lit(1)).alias("n")),
    "sample_adequacy": lambda s, d: discovery.sample_adequacy(discovery.reviews_per_product(lines(s, d))),
    "stratified_sample": lambda s, d: sampling.stratified_sample(A.reviews(s, d), limit=150).select(
        "review_id", "star_rating"
    ),
    "seeded_sample": lambda s, d: sampling.sample_n(A.reviews(s, d), 50).select("review_id", "product_id"),
    "silent_killer_diagnosis": lambda s, d: rounded(diagnosis.silent_killer_diagnosis(scored(s, d)), 4),
}

_REPORT = """count(*) AS total_reviews, round(avg(star_rating), 4) AS avg_star, round(avg(sentiment_score), 4) + 0 AS avg_sentiment,
  round(avg(star_gap), 4) + 0 AS avg_star_gap, count_if(is_silent_killer)::bigint AS silent_killers,
  round(count_if(is_silent_killer) * 100.0::double / count(*), 4) AS silent_killer_pct,
  round(sum(revenue_at_risk), 4) AS revenue_at_risk"""
_SEGMENT = """CASE WHEN star_rating >= 4 AND sentiment_score < 0 THEN 'Silent Killers'
  WHEN star_rating >= 4 AND sentiment_score >= 0.5 THEN 'Loyalists'
  WHEN star_rating <= 2 AND sentiment_score < 0 THEN 'Vocal Detractors'
  WHEN star_rating = 3 AND sentiment_score < 0 THEN 'At Risk' ELSE 'Other' END AS segment"""

ORACLES = {
    "review_weight": query(f"""
        SELECT review_id, helpful_votes, verified_purchase,
          {rnd("(1 + ln(1 + helpful_votes)) * CASE WHEN verified_purchase THEN 1.2 ELSE 1.0 END", "sk_weight")} FROM reviews"""),
    "sentiment_score": query(f"""
        SELECT product_id, {rnd("avg(sentiment_score)", "avg_score")}, {rnd("min(sentiment_score)", "min_score")},
          {rnd("max(sentiment_score)", "max_score")} FROM lines GROUP BY ALL"""),
    "star_gap": query(f"""
        SELECT review_id, {rnd("(star_rating - 3) / 2", "star_normalized")}, {rnd("sentiment_score", "sentiment_score")},
          {rnd("(star_rating - 3) / 2 - sentiment_score", "star_gap")} FROM scored"""),
    "silent_killers": query(f"""
        SELECT review_id, product_id, star_rating, {rnd("prob_negative", "prob_negative")},
          {rnd("prob_positive", "prob_positive")}, is_silent_killer FROM flagged"""),
    "revenue_at_risk": query("""
        SELECT product_id, count_if(is_silent_killer)::bigint AS silent_killers, round(sum(revenue_at_risk), 2) AS revenue_at_risk
        FROM lines_flagged GROUP BY ALL"""),
    "revenue_at_risk_naive": query("""
        SELECT product_id, count_if(is_silent_killer)::bigint AS silent_killers,
          (count_if(is_silent_killer) * 750)::double AS revenue_at_risk FROM lines_flagged GROUP BY ALL"""),
    "sk_threshold": query(_percentiles("lines")),
    "sk_threshold_by_product": query(_percentiles("lines", "GROUP BY product_id").replace("SELECT", "SELECT product_id,", 1)),
    "pooled_sk_threshold": query(f"""
        SELECT count(*) AS n_rows,
          {rnd("CASE WHEN count(*) >= 10 THEN quantile_cont(prob_negative, 0.1) ELSE 0.5 END", "threshold")}
        FROM (SELECT star_rating, prob_negative FROM scored UNION ALL SELECT star_rating, prob_negative FROM lines)
        WHERE star_rating <= 2"""),
    "diagnostic_report": query(f"SELECT product_id, {_REPORT} FROM lines_flagged GROUP BY ALL"),
    "model_sanity": query(f"""
        SELECT product_id, {rnd("a", "one_star_negative_rate")}, {rnd("b", "five_star_positive_rate")},
          coalesce(a < 0.5 OR b < 0.6, false) AS low_agreement
        FROM (SELECT product_id, avg(CASE WHEN star_rating = 1 THEN (prob_negative > prob_positive)::int END) AS a,
                avg(CASE WHEN star_rating = 5 THEN (prob_positive > prob_negative)::int END) AS b
              FROM scored GROUP BY ALL)"""),
    "star_sentiment_corr": query(f"""
        SELECT n, {rnd("r", "pearson_r")}, coalesce(r < 0.5, false) AS weak_correlation
        FROM (SELECT count(*) AS n, corr((star_rating - 3) / 2, sentiment_score) AS r FROM lines)"""),
    "top_silent_killers": query(f"""
        SELECT review_id, product_id, star_rating, {rnd("prob_negative", "prob_negative")}, helpful_votes,
          {rnd("sk_weight", "sk_weight")}, {rnd("revenue_at_risk", "revenue_at_risk")},
          replace(substr(review_text, 1, 120), chr(10), ' ') AS snippet
        FROM flagged WHERE is_silent_killer ORDER BY flagged.revenue_at_risk DESC, review_id LIMIT 5"""),
    "validation_sample": query(f"""
        SELECT review_id, review_text, star_rating, {rnd("prob_negative", "prob_negative")}, {rnd("prob_positive", "prob_positive")},
          {rnd("prob_neutral", "prob_neutral")}, helpful_votes, verified_purchase, {rnd("sk_weight", "sk_weight")},
          {rnd("revenue_at_risk", "revenue_at_risk")}, {rnd("star_gap", "star_gap")}, is_silent_killer, '' AS manually_correct
        FROM flagged WHERE is_silent_killer ORDER BY flagged.revenue_at_risk DESC, review_id LIMIT 50"""),
    "validation_precision": query(f"""
        SELECT count(*) AS n, {rnd("avg(quality)", "precision")} FROM flagged JOIN labels ON doc_id = review_id WHERE is_silent_killer"""),
    "customer_segments": query(f"SELECT review_id, star_rating, {rnd('sentiment_score', 'sentiment_score')}, {_SEGMENT} FROM scored")
        .replace("WHEN star_rating >= 4 AND sentiment_score", "WHEN star_rating >= 4 AND scored.sentiment_score")
        .replace("WHEN star_rating <= 2 AND sentiment_score", "WHEN star_rating <= 2 AND scored.sentiment_score")
        .replace("WHEN star_rating = 3 AND sentiment_score", "WHEN star_rating = 3 AND scored.sentiment_score"),
    "segment_counts": query(f"SELECT segment, count(*) AS n FROM (SELECT {_SEGMENT} FROM lines) GROUP BY ALL"),
    "tone_label": query("""
        SELECT product_id, CASE WHEN sentiment_score < -0.1 THEN 'negative' WHEN sentiment_score > 0.1 THEN 'positive'
          ELSE 'mixed/neutral' END AS tone, count(*) AS n FROM lines GROUP BY ALL"""),
    "sample_adequacy": query("""
        SELECT product_id, review_count, required, review_count >= required AS adequate
        FROM (SELECT product_id, count(*) AS review_count FROM lines GROUP BY ALL),
          (SELECT ceil(384.16 / (1 + (384.16 - 1) / count(*)))::bigint AS required FROM lines)"""),
    "stratified_sample": query("""
        SELECT review_id, star_rating
        FROM (SELECT review_id, star_rating,
                row_number() OVER (PARTITION BY star_rating ORDER BY md5(review_id::varchar || '42'), review_id) AS n,
                floor(150 * count(*) OVER (PARTITION BY star_rating) / count(*) OVER ()) AS quota, count(*) OVER () AS total
              FROM reviews) WHERE n <= quota OR total <= 150"""),
    "seeded_sample": query("SELECT review_id, product_id FROM reviews ORDER BY md5(review_id::varchar || '42'), review_id LIMIT 50"),
    "silent_killer_diagnosis": query(f"""
        SELECT product_id, {_REPORT}, round(corr(star_normalized, sentiment_score), 4) + 0 AS pearson_r FROM flagged GROUP BY ALL"""),
}
