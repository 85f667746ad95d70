"""Monthly series, smoothing, changepoints, anomalies and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import anomalies, forecast, quality, ranking, rollups, silent_killers, trend
from ..session import read_back
from .common import labelled, lines_flagged, rounded
from .sql import query, rnd

_DAY = dates.iso_day


def _monthly(spark, sf):
    return trend.monthly_metrics(labelled(spark, sf))


def _stored(spark, sf):
    """Monthly rows written once, for what reads them more than once."""
    return read_back(spark, _monthly(spark, sf), "monthly")


def _rolled(spark, sf):
    rows = labelled(spark, sf).select(
        "review_id", "product_id", "lang", "review_date", "star_rating", "prob_negative", "sentiment_score", "is_silent_killer", "emo_anger", "emo_sadness"
    )
    return read_back(spark, rollups.roll_up(rows, ["review_id", "lang"]), "rollup")


def _sketched(spark, sf):
    """Estimates from the rollup beside the exact answers."""
    rolled, rows = _rolled(spark, sf), labelled(spark, sf)
    exact = quality.distinct_counts(rows, ["review_id", "lang"])
    bar = ranking.one_value(rollups.threshold_from_rollup(rolled), "threshold")
    pairs = [(c, F.col(c), ranking.one_value(exact, c)) for c in ("review_id", "lang")] + [("p10", bar, silent_killers.threshold_value(rows))]
    return rollups.distinct_from_rollup(rolled).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), e.cast("double").alias("estimate"), x.cast("double").alias("exact")) for n, e, x in pairs
    ])).alias("r")).select("r.*")


def _text_month(df, *columns, digits=6):
    return rounded(df.select("product_id", F.date_format("month", "yyyy-MM-dd").alias("month"), *columns), digits)


def _overall(spark, sf, width=3, min_rows=3):
    """The whole catalogue as one series, months of at least ten reviews."""
    monthly = trend.monthly_metrics(lines_flagged(spark, sf), 10, by=[])
    return trend.delta(
        monthly.withColumn("rolling", trend.rolling_mean("mean_sentiment", width, min_rows, [])), "mean_sentiment", []
    )


def _forecast(spark, sf, interval=True):
    return forecast.forecast(_stored(spark, sf), interval=interval)


QUERIES = {
    "monthly_metrics": lambda s, d: _text_month(
        _monthly(s, d), "review_count", "sk_count", "mean_sentiment", "mean_anger", "mean_sadness", "sk_rate", "urgency"
    ),
    "rollup_monthly_metrics": lambda s, d: _text_month(
        rollups.monthly_from_rollup(_rolled(s, d)), "review_count", "sk_count", "mean_sentiment", "mean_anger", "mean_sadness", "sk_rate", "urgency"
    ),
    "rollup_sketches": _sketched,
    "monthly_sk_join": lambda s, d: _text_month(
        trend.monthly_sk_join(lines_flagged(s, d), 3), "review_count", "sk_count", "sk_rate"
    ),
    "rolling_sentiment": lambda s, d: _text_month(
        trend.smooth(_monthly(s, d)), F.coalesce("smooth_sentiment", F.lit(-9.0)).alias("smooth_sentiment"),
        F.coalesce("smooth_sk_rate", F.lit(-9.0)).alias("smooth_sk_rate"),
    ),
    "rolling_sentiment_3": lambda s, d: rounded(_overall(s, d).select(
        F.date_format("month", "yyyy-MM-dd").alias("month"), "review_count", F.coalesce("rolling", F.lit(-9.0)).alias("rolling")
    )),
    "sentiment_delta": lambda s, d: rounded(_overall(s, d).select(
        F.date_format("month", "yyyy-MM-dd").alias("month"), F.coalesce("sentiment_delta", F.lit(-9.0)).alias("sentiment_delta")
    )),
    "sentiment_changepoint": lambda s, d: rounded(
        trend.changepoint(trend.delta(trend.smooth(_monthly(s, d)))).select(
            "product_id", F.date_format("changepoint_month", "yyyy-MM-dd").alias("changepoint_month"), "drop"
        )
    ),
    "temporal_trend": lambda s, d: _text_month(
        trend.temporal_trend(labelled(s, d)), "review_count", "mean_sentiment", "sk_rate",
        F.coalesce("smooth_sentiment", F.lit(-9.0)).alias("smooth_sentiment"),
        F.coalesce("sentiment_delta", F.lit(-9.0)).alias("sentiment_delta"), "is_changepoint",
    ),
    "monthly_anomalies": lambda s, d: anomalies.isolation_forest(_stored(s, d)).select(
        "product_id", "month", "review_count", "anomaly_score", "anomaly_prob", "is_anomaly"
    ),
    "monthly_anomalies_robust": lambda s, d: _text_month(
        anomalies.robust_anomaly(_monthly(s, d)), "robust_z", "is_anomaly", digits=9
    ),
    "top_anomalies": lambda s, d: anomalies.top_anomalies(anomalies.isolation_forest(_stored(s, d))).select(
        "product_id", "rank_no", "month", "anomaly_prob"
    ),
    "sentiment_forecast": lambda s, d: rounded(_forecast(s, d, interval=False).select(
        "product_id", F.date_format("month", "yyyy-MM-dd").alias("month"), "fitted", "is_forecast", "direction"
    ), 5),
    "forecast_bootstrap_ci": lambda s, d: _text_month(_forecast(s, d).filter("is_forecast"), "fitted", "ci_lo", "ci_hi", digits=5),
    "forecast_sufficient_stats": lambda s, d: rounded(forecast.sufficient_stats(_monthly(s, d))),
}

_M = "strftime(month, '%Y-%m-%d') AS month"
_OVERALL = {
    "whole": """
        SELECT last_day(review_date) AS month, count(*) AS review_count, avg(sentiment_score) AS mean_sentiment
        FROM lines GROUP BY ALL HAVING count(*) >= 10""",
    "whole_smooth": """
        SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(mean_sentiment) OVER w END AS rolling,
          mean_sentiment - lag(mean_sentiment) OVER (ORDER BY month) AS sentiment_delta
        FROM whole WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
}
_CHANGE = {
    "stable": "SELECT *, review_count >= 5 AS ok, bool_or(review_count >= 5) OVER (PARTITION BY product_id) AS any_ok FROM deltas",
    "changes": """
        SELECT product_id, month AS turn, sentiment_delta AS fall FROM stable WHERE ok = any_ok AND sentiment_delta IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY round(sentiment_delta, 9), month) = 1""",
}
_MAD = {
    "centre": """SELECT product_id, quantile_cont(mean_sentiment, 0.5) AS m1, quantile_cont(sk_rate, 0.5) AS m2,
        quantile_cont(urgency, 0.5) AS m3, quantile_cont(review_count, 0.5) AS m4 FROM monthly GROUP BY ALL""",
    "apart": """SELECT product_id, month, abs(mean_sentiment - m1) AS d1, abs(sk_rate - m2) AS d2, abs(urgency - m3) AS d3,
        abs(review_count - m4) AS d4 FROM monthly JOIN centre USING (product_id)""",
    "spread": """SELECT product_id, quantile_cont(d1, 0.5) AS s1, quantile_cont(d2, 0.5) AS s2, quantile_cont(d3, 0.5) AS s3,
        quantile_cont(d4, 0.5) AS s4 FROM apart GROUP BY ALL""",
    "robust": "SELECT product_id, month, greatest(" + ", ".join(
        f"CASE WHEN s{i} = 0 THEN 0 ELSE d{i} * 0.6745::double / s{i} END" for i in range(1, 5)
    ) + ") AS z FROM apart JOIN spread USING (product_id)",
}
# The 3 x 3 ridge system solved in SQL by Cramer's rule on centred, scaled powers.
_FIT = {
    "placed": """
        SELECT product_id, month, mean_sentiment AS y, t, t / c AS x1, (t / c) ** 2 AS x2, (t / c) ** 3 AS x3, c, n
        FROM (SELECT *, greatest(max(t) OVER (PARTITION BY product_id), 1)::double AS c, count(*) OVER (PARTITION BY product_id) AS n
              FROM (SELECT *, date_diff('day', min(month) OVER (PARTITION BY product_id), month)::double AS t FROM monthly)) WHERE n >= 6""",
    "sums": "SELECT product_id, max(c) AS c, max(t) AS t_last, max(month) AS last_month, avg(y) AS ym, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, "
        + ", ".join(f"(covar_pop(x{i}, x{j}) * count(*))" + (f" + 10 / max(c) ** {2 * i}" if i == j else "") + f" AS a{i}{j}"
                    for i in (1, 2, 3) for j in (1, 2, 3) if j >= i)
        + ", " + ", ".join(f"covar_pop(x{i}, y) * count(*) AS b{i}" for i in (1, 2, 3)) + " FROM placed GROUP BY ALL",
    "solved": """
        SELECT *, (b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3)) / det AS k1,
          (a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13)) / det AS k2,
          (a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13)) / det AS k3
        FROM (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM sums)""",
    "horizon": """
        SELECT product_id, last_day((date_trunc('month', last_month) + to_months(i::int))::date) AS month, (t_last + 30 * i) / c AS x, true AS is_forecast, i
        FROM solved, (SELECT unnest(generate_series(1, 6)) AS i)
        UNION ALL SELECT product_id, month, x1, false, 0 FROM placed""",
    "fits": """
        SELECT product_id, horizon.month, is_forecast, i, ym + k1 * (x - m1) + k2 * (x * x - m2) + k3 * (x * x * x - m3) AS fitted
        FROM horizon JOIN solved USING (product_id)""",
}

_AWAY = {1: "p.x", 2: "p.x * p.x", 3: "p.x * p.x * p.x"}


def _fold(value: str) -> str:
    return f"list_reduce(list_transform(picks, lambda p: {value}), lambda a, b: a + b)"


# The same fit over months picked by digests, 500 times, folded in the same order.
_BOOT = {
    **_FIT,
    "series": """
        SELECT product_id, list(struct_pack(x := x1, y := round(y, 9)) ORDER BY month) AS points, max(c) AS c, max(t) AS t_last, max(n)::bigint AS n, max(month) AS last_month
        FROM placed GROUP BY ALL""",
    "resampled": """
        SELECT product_id, r, c, t_last, n,
          list_transform(range(n), lambda j: points[1 + ('0x' || substr(md5(product_id || '|' || r::varchar || '|' || j::varchar || '|42'), 1, 8))::bigint % n]) AS picks
        FROM series, (SELECT unnest(range(500)) AS r)""",
    "boot_means": f"SELECT *, {_fold('p.y')} / n AS m0, " + ", ".join(f"{_fold(_AWAY[i])} / n AS m{i}" for i in (1, 2, 3)) + " FROM resampled",
    "boot_sums": "SELECT * EXCLUDE (picks), " + ", ".join(
        _fold(f"({_AWAY[i]} - m{i}) * ({_AWAY[j]} - m{j})") + (f" + 10 / ({' * '.join(['c'] * (2 * i))})" if i == j else "") + f" AS a{i}{j}"
        for i in (1, 2, 3) for j in (1, 2, 3) if j >= i
    ) + ", " + ", ".join(_fold(f"({_AWAY[i]} - m{i}) * (p.y - m0)") + f" AS b{i}" for i in (1, 2, 3)) + " FROM boot_means",
    "boot_first": "SELECT * REPLACE (a22 - a12 / a11 * a12 AS a22, a23 - a12 / a11 * a13 AS a23, b2 - a12 / a11 * b1 AS b2, a33 - a13 / a11 * a13 AS a33, b3 - a13 / a11 * b1 AS b3) FROM boot_sums",
    "boot_second": "SELECT * REPLACE (a33 - a23 / a22 * a23 AS a33, b3 - a23 / a22 * b2 AS b3) FROM boot_first",
    "boot_third": "SELECT *, coalesce(b3 / nullif(a33, 0), 0) AS k3 FROM boot_second",
    "boot_fourth": "SELECT *, coalesce((b2 - a23 * k3) / nullif(a22, 0), 0) AS k2 FROM boot_third",
    "boot_fits": "SELECT *, coalesce((b1 - a12 * k2 - a13 * k3) / nullif(a11, 0), 0) AS k1 FROM boot_fourth",
    "boot_values": """
        SELECT product_id, i, m0 + k1 * (x - m1) + k2 * (x * x - m2) + k3 * (x * x * x - m3) AS v
        FROM (SELECT *, (t_last + 30 * i) / c AS x FROM boot_fits, (SELECT unnest(generate_series(1, 6)) AS i))""",
    "bounds": "SELECT product_id, i, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM boot_values GROUP BY ALL",
}

ORACLES = {
    "forecast_bootstrap_ci": query(f"""
        SELECT product_id, strftime(month, '%Y-%m-%d') AS month, {rnd("fitted", "fitted", 5)}, {rnd("lo", "ci_lo", 5)}, {rnd("hi", "ci_hi", 5)}
        FROM fits JOIN bounds USING (product_id, i) WHERE is_forecast""", **_BOOT),
    "monthly_metrics": query(f"SELECT product_id, {_M}, review_count, sk_count, " + ", ".join(
        rnd(c, c) for c in ("mean_sentiment", "mean_anger", "mean_sadness", "sk_rate", "urgency")) + " FROM monthly"),
    "monthly_sk_join": query(f"""
        SELECT product_id, strftime(m, '%Y-%m-%d') AS month, review_count, coalesce(k, 0) AS sk_count,
          {rnd("coalesce(k, 0) * 100.0::double / review_count", "sk_rate")}
        FROM (SELECT product_id, last_day(review_date) AS m, count(*) AS review_count FROM lines GROUP BY ALL HAVING count(*) >= 3)
        LEFT JOIN (SELECT product_id, last_day(review_date) AS m, count(*) AS k FROM lines_flagged WHERE is_silent_killer GROUP BY ALL)
          USING (product_id, m)"""),
    "rolling_sentiment": query(f"""
        SELECT product_id, {_M}, {rnd("coalesce(smooth_sentiment, -9)", "smooth_sentiment")},
          {rnd("coalesce(smooth_sk_rate, -9)", "smooth_sk_rate")} FROM smoothed"""),
    "rolling_sentiment_3": query(f"SELECT {_M}, review_count, {rnd('coalesce(rolling, -9)', 'rolling')} FROM whole_smooth", **_OVERALL),
    "sentiment_delta": query(f"SELECT {_M}, {rnd('coalesce(sentiment_delta, -9)', 'sentiment_delta')} FROM whole_smooth", **_OVERALL),
    "sentiment_changepoint": query(f"""
        SELECT product_id, strftime(turn, '%Y-%m-%d') AS changepoint_month, {rnd("abs(fall)", "drop")} FROM changes""", **_CHANGE),
    "temporal_trend": query(f"""
        SELECT product_id, {_M}, review_count, {rnd("mean_sentiment", "mean_sentiment")}, {rnd("sk_rate", "sk_rate")},
          {rnd("coalesce(smooth_sentiment, -9)", "smooth_sentiment")}, {rnd("coalesce(sentiment_delta, -9)", "sentiment_delta")},
          coalesce(deltas.month = turn, false) AS is_changepoint
        FROM deltas LEFT JOIN changes USING (product_id)""", **_CHANGE),
    "monthly_anomalies_robust": query(f"SELECT product_id, {_M}, {rnd('z', 'robust_z', 9)}, z > 3.5 AS is_anomaly FROM robust", **_MAD),
    "sentiment_forecast": query(f"""
        SELECT product_id, strftime(month, '%Y-%m-%d') AS month, {rnd("fitted", "fitted", 5)}, is_forecast,
          CASE WHEN max(fitted) FILTER (i = 6) OVER (PARTITION BY product_id) > max(fitted) FILTER (i = 1) OVER (PARTITION BY product_id)
            THEN 'improving' ELSE 'declining' END AS direction FROM fits""", **_FIT),
    "forecast_sufficient_stats": query("SELECT product_id, count(*) AS n, max(s) AS scale, " + ", ".join(
        rnd(f"sum(x ** {p})", f"s{p}") for p in range(1, 7)) + ", " + ", ".join(
        rnd(f"sum(x ** {p} * mean_sentiment)", f"sy{p}") for p in range(0, 4)) + """
        FROM (SELECT *, t / s AS x FROM (SELECT *, greatest(max(t) OVER (PARTITION BY product_id), 1)::double AS s
              FROM (SELECT *, date_diff('day', min(month) OVER (PARTITION BY product_id), month)::double AS t FROM monthly))) GROUP BY ALL"""),
}

ORACLES["rollup_monthly_metrics"] = ORACLES["monthly_metrics"]
