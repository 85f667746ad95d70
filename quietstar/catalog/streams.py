"""Streams over the event table, checked against the same result in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import silent_killers
from ..session import read_back
from ..sources import adapters as A
from ..streaming import arrivals
from .common import rounded
from .sql import query, rnd


def _stream(spark, sf):
    schema = A.table(spark, sf, "events").schema
    return A.event_reviews(arrivals.file_stream(spark, sf, schema, "events.parquet"))


def _flags(spark, sf):
    """Bars per product, frozen from the stored table before the stream starts."""
    history = A.event_reviews(A.table(spark, sf, "events"))
    bars = read_back(spark, silent_killers.sk_threshold(history, {"threshold": 0.10}, by=["product_id"]), "bars")
    return rounded(arrivals.flag_stream(_stream(spark, sf), bars))


def _dedup(spark, sf):
    """Every event delivered twice."""
    once = _stream(spark, sf)
    unique = arrivals.dedup_stream(once.unionByName(_stream(spark, sf)))
    return unique.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("review_id").alias("ids"))


QUERIES = {
    "stream_product_counts": lambda s, d: arrivals.running_counts(_stream(s, d)),
    "stream_window_metrics": lambda s, d: rounded(arrivals.window_metrics(_stream(s, d))),
    "stream_flagging": _flags,
    "stream_dedup": _dedup,
}

ORACLES = {
    "stream_product_counts": query("SELECT product_id, count(*) AS review_count FROM arrivals GROUP BY ALL"),
    # A window is emitted when the watermark (latest event minus one day) has passed its end.
    "stream_window_metrics": query(f"""
        SELECT strftime(w, '%Y-%m-%d') AS window_start, product_id, count(*) AS review_count, {rnd("avg(star_rating)", "avg_star")},
          {rnd("avg(prob_positive - prob_negative)", "avg_sentiment")}
        FROM (SELECT *, time_bucket(INTERVAL 7 DAY, event_time, TIMESTAMP '1970-01-01') AS w FROM arrivals)
        WHERE w + INTERVAL 7 DAY <= (SELECT max(event_time) - INTERVAL 1 DAY FROM arrivals) GROUP BY w, product_id"""),
    "stream_flagging": query(f"""
        SELECT review_id, arrivals.product_id, star_rating, {rnd("prob_negative", "prob_negative")},
          coalesce(star_rating >= 4 AND prob_negative > prob_positive AND prob_negative >= threshold, false) AS is_silent_killer
        FROM arrivals LEFT JOIN (SELECT product_id, quantile_cont(prob_negative, 0.1) AS threshold FROM arrivals
                                 WHERE star_rating <= 2 GROUP BY ALL) t USING (product_id)""".replace(
        "prob_negative >= threshold", "arrivals.prob_negative >= threshold").replace("AND prob_negative >", "AND arrivals.prob_negative >")),
    "stream_dedup": query("SELECT product_id, count(*) AS n, count(DISTINCT review_id) AS ids FROM arrivals GROUP BY ALL"),
}
