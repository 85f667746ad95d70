"""Brute-force and property checks, on skewed inputs where skew matters."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quietstar.catalog import common
from quietstar.operators import anomalies, aspects, churn, discovery, forecast, ranking, search, sentiment, silent_killers as sk, strategy, trend
from quietstar.sources import adapters as A


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows in one key, many ties, negative and large values."""
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"k": np.where(rng.random(4000) < 0.5, "hot", rng.choice(list("abcdef"), 4000))})
    frame["v"] = np.round(rng.normal(0, 50, 4000), 1) * np.where(rng.random(4000) < 0.3, 0, 1)
    frame["id"] = np.arange(4000)
    frame["y"] = (rng.random(4000) < 0.2).astype(int)
    return frame, spark.createDataFrame(frame).repartition(8).cache()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact_percentiles_match_numpy(skewed, keys):
    frame, df = skewed
    wanted = {"p00": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = ranking.exact_percentiles(df, keys, "v", wanted).toPandas()
    for _, row in got.iterrows():
        values = frame[frame["k"] == row["k"]]["v"] if keys else frame["v"]
        assert row["n_rows"] == len(values)
        for name, p in wanted.items():
            assert row[name] == pytest.approx(np.percentile(values, 100 * p), abs=1e-9)


def test_auroc_matches_pairs(skewed):
    frame, df = skewed
    got = ranking.auroc(df, "v", "y", ["k"]).toPandas().set_index("k")["auroc"]
    for key, part in frame.groupby("k"):
        pos, neg = part[part["y"] == 1]["v"].to_numpy(), part[part["y"] == 0]["v"].to_numpy()
        wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
        assert got[key] == pytest.approx(wins)


def test_top_and_first_per_group_match_a_plain_window(skewed):
    frame, df = skewed
    order = [F.desc("v"), F.asc("id")]
    ordered = frame.sort_values(["v", "id"], ascending=[False, True])
    want = {(r.k, r.id) for r in ordered.groupby("k").head(7).itertuples()}
    for got in (
        ranking.top_per_group(df, ["k"], order, 7), ranking.top_per_group(df, ["k"], order, 7, spread_by=F.col("id")),
        ranking.first_per_group(df, ["k"], order, F.when(F.col("k") == "hot", 7).otherwise(7), 50, F.col("id")),
    ):
        assert {(r["k"], r["id"]) for r in got.collect()} == want


def test_digest_positions_are_ranks_and_respect_quota(skewed):
    frame, df = skewed
    digest = F.md5(F.col("id").cast("string"))
    placed = ranking.digest_positions(df, ["k"], digest, "id").toPandas()
    for _, part in placed.groupby("k"):
        assert sorted(part["position"]) == list(range(1, len(part) + 1))
        assert (part["group_size"] == len(part)).all()
    cut = ranking.digest_positions(df, ["k"], digest, "id", F.floor(F.col("group_size") / 10)).toPandas()
    assert set(cut["id"]) == set(placed[placed["position"] <= placed["group_size"] // 10]["id"])


def test_semantic_search_matches_brute_force(spark, sf_dir):
    index = A.table(spark, sf_dir, "embeddings")
    frame = index.toPandas()
    x = np.stack(frame["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = index.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = search.semantic_search(index.repartition(5), queries, 4).toPandas()
    for q, part in got.groupby("query_id"):
        sims = np.round(x @ x[frame.index[frame["vec_id"] == q][0]], 9)
        want = frame["vec_id"].to_numpy()[np.lexsort((frame["vec_id"], -sims))[:4]]
        assert list(part.sort_values("rank_no")["vec_id"]) == list(want)


def test_search_runs_in_blocks_without_losing_queries(spark, sf_dir, monkeypatch):
    index = A.table(spark, sf_dir, "embeddings")
    queries = index.limit(10).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    whole = search.semantic_search(index, queries, 3).orderBy("query_id", "rank_no").collect()
    monkeypatch.setattr(search, "BLOCK", 4)
    assert search.semantic_search(index, queries, 3).orderBy("query_id", "rank_no").collect() == whole
    assert search.semantic_search(index, queries.filter("query_id < 0"), 3).count() == 0


def test_scores_and_flags_hold_their_invariants(spark, sf_dir):
    rows = common.labelled(spark, sf_dir)
    bad = rows.filter(
        (F.abs(F.col("prob_negative") + F.col("prob_neutral") + F.col("prob_positive") - 1) > 1e-12)
        | (F.abs("sentiment_score") > 1)
        | (F.col("is_silent_killer") & (F.col("star_rating") < 4))
        | (F.col("is_silent_killer") != (F.col("revenue_at_risk") > 0))
    )
    assert bad.count() == 0


def test_lower_percentile_never_flags_fewer(spark, sf_dir):
    scored = common.scored(spark, sf_dir)
    counts = [
        sk.flag_silent_killers(scored, sk.threshold_value(scored, p)).filter("is_silent_killer").count() for p in (0.5, 0.25, 0.1)
    ]
    assert counts == sorted(counts)


def test_shares_sum_to_one_hundred(spark, sf_dir):
    rows = common.topical_stage(spark, sf_dir)
    heat = aspects.emotion_heatmap(rows).withColumn("t", F.col("anger") + F.col("disappointment") + F.col("joy"))
    assert heat.filter(F.abs(F.col("t") - 100) > 1e-9).count() == 0
    stats = aspects.aspect_stats(rows)
    assert stats.groupBy("product_id").agg(F.sum("frequency_pct").alias("t")).filter("abs(t - 100) > 1e-9").count() == 0
    simulated = strategy.roi_simulation(rows, stats).join(strategy.roi_target(stats), "product_id")
    assert simulated.filter("target_mean < 0 AND improvement_pct_high < improvement_pct_low").count() == 0


def test_isolation_forest_finds_planted_months(spark):
    rng = np.random.default_rng(3)
    rows = []
    for p in ("a", "b"):
        for i in range(40):
            odd = i in (10, 30)
            rows.append((p, dt.date(2018 + i // 12, i % 12 + 1, 28), float(rng.normal(-3 if odd else 0.3, 0.05)),
                         float(60 if odd else rng.normal(8, 1)), float(rng.normal(0.3, 0.02)), 20))
    monthly = spark.createDataFrame(rows, "product_id string, month date, mean_sentiment double, sk_rate double, urgency double, review_count long")
    got = anomalies.isolation_forest(monthly).toPandas()
    for _, part in got.groupby("product_id"):
        assert part["is_anomaly"].sum() == 4
        assert set(part.nlargest(2, "anomaly_prob")["month"]) == {dt.date(2018, 11, 28), dt.date(2020, 7, 28)}
        assert part["anomaly_prob"].between(0, 1).all()
        assert set(part[part["is_anomaly"]]["anomaly_score"]) == {-1}
    again = anomalies.isolation_forest(monthly.repartition(3)).toPandas()
    merged = got.merge(again, on=["product_id", "month"])
    assert (merged["anomaly_prob_x"] == merged["anomaly_prob_y"]).all()


def test_forecast_is_the_unscaled_ridge_fit(spark):
    months = pd.date_range("2019-01-31", periods=20, freq="ME")
    y = np.sin(np.arange(20) / 4)
    monthly = spark.createDataFrame(
        [("p", m.date(), float(v)) for m, v in zip(months, y)] + [("short", m.date(), 0.0) for m in months[:5]],
        "product_id string, month date, mean_sentiment double",
    )
    got = forecast.forecast(monthly).toPandas().sort_values("month")
    assert set(got["product_id"]) == {"p"} and len(got) == 26
    t = np.array([(m - months[0]).days for m in months], dtype=np.longdouble)
    at = np.concatenate([t, t[-1] + 30 * np.arange(1, 7)])
    x = np.stack([t, t**2, t**3], axis=1)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    scale = np.array([1, t[-1], t[-1] ** 2]) * t[-1]
    a = (xc / scale).T @ (xc / scale) + np.diag(10.0 / scale**2)
    beta = np.linalg.solve(a.astype(float), ((xc / scale).T @ yc).astype(float)) / scale.astype(float)
    line = y.mean() + ((np.stack([at, at**2, at**3], axis=1) - x.mean(axis=0)) @ beta)
    assert np.allclose(got["fitted"], line.astype(float), atol=1e-6)
    future = got[got["is_forecast"]]
    assert (future["ci_lo"] <= future["ci_hi"]).all() and got[~got["is_forecast"]]["ci_lo"].isna().all()
    assert list(future["month"])[0] == dt.date(2020, 9, 30)


@pytest.mark.parametrize("r, n, want", [(0.5, 10, 0.14111328125), (-0.5, 10, 0.14111328125), (0.0, 30, 1.0), (1.0, 5, 0.0)])
def test_pearson_p_value(spark, r, n, want):
    got = spark.range(1).select(sk.pearson_p(F.lit(r), F.lit(n)).alias("p")).first()["p"]
    assert got == pytest.approx(want, abs=1e-9)


def test_churn_learns_without_leaking(spark):
    rng = np.random.default_rng(5)
    n = 600
    anger = rng.random(n)
    frame = pd.DataFrame({
        "review_id": np.arange(n), "helpful_votes": rng.integers(0, 20, n), "verified_purchase": rng.random(n) < 0.8,
        "emo_anger": anger, "emo_sadness": rng.random(n), "emo_joy": rng.random(n), "review_length": rng.integers(10, 500, n),
        "is_silent_killer": (anger + rng.normal(0, 0.1, n)) > 0.85,
    })
    table = churn.stratified_split(churn.training_table(spark.createDataFrame(frame))).cache()
    assert table.filter("is_test").count() == sum(math.floor(0.2 * (frame["is_silent_killer"] == c).sum()) for c in (True, False))
    model = churn.fit_churn(table.filter("NOT is_test"), trees=10)
    scored = churn.predict_churn(table.filter("is_test"), model)
    assert ranking.auroc(scored, "churn_risk_score", "label").first()["auroc"] > 0.85
    importance = churn.feature_importance(model)
    assert importance.first()["feature"] == "emo_anger"
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    audit = churn.leakage_audit(spark.createDataFrame(frame.assign(star_rating=5.0)), ["emo_anger", "star_rating"])
    assert {r["feature"]: r["leaks"] for r in audit.collect()} == {"emo_anger": False, "star_rating": True}


def test_folds_balance_classes(spark):
    df = spark.range(103).select(F.col("id").alias("review_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    sizes = churn.stratified_folds(df).groupBy("label", "fold").count().toPandas()
    for _, part in sizes.groupby("label"):
        assert len(part) == 5 and part["count"].max() - part["count"].min() <= 1


def test_changepoint_falls_back_to_thin_months(spark):
    rows = [("p", dt.date(2021, m, 3), s, False) for m, s in ((1, 0.9), (2, 0.1), (3, 0.0)) for _ in range(3)]
    df = spark.createDataFrame(rows, "product_id string, review_date date, sentiment_score double, is_silent_killer boolean")
    monthly = trend.delta(trend.monthly_metrics(df), "mean_sentiment")
    assert trend.changepoint(monthly).first()["changepoint_month"] == dt.date(2021, 2, 28)


def test_foreign_text_is_translated_whole(spark):
    body = "wort " * 1000
    df = spark.createDataFrame([("de", body)], "detected_lang string, review_text string")
    out = sentiment.translate_selective(df, sentiment.dictionary_translator({"wort": "word"})).first()
    assert out["review_text"] == body.replace("wort", "word") and out["was_translated"]


def test_repeated_reviews_count_once_under_a_cap(spark):
    rows = [("p", i % 5, i % 5, "t") for i in range(10)]
    df = spark.createDataFrame(rows, "product_id string, review_id long, unix_time long, review_text string")
    chosen = spark.createDataFrame([("p", True)], "product_id string, is_flagship boolean")
    assert discovery.cap_per_product(df, chosen, flagship_cap=3, rival_cap=1).count() == 3
    assert discovery.cap_per_product(df, chosen, flagship_cap=9, rival_cap=1).count() == 5


def test_registered_churn_queries_boost_in_full(spark, sf_dir, monkeypatch):
    from quietstar.catalog import models

    class Reached(Exception):
        pass

    def booster(**given):
        raise Reached(given["maxIter"])

    monkeypatch.setattr(churn, "GBTClassifier", booster)
    for name in ("churn_scores", "churn_cv", "feature_importance", "ml_metrics"):
        with pytest.raises(Reached, match="^300$"):
            models.QUERIES[name](spark, sf_dir)
