"""Histogram boosting against a single-process version of the same rounds, and against Spark's own trainer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quietstar.operators import boosting, churn, ranking


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(11)
    n = 1500
    anger = draw.random(n)
    frame = pd.DataFrame({
        "review_id": np.arange(n), "helpful_votes": draw.integers(0, 20, n), "verified_purchase": draw.random(n) < 0.8, "emo_anger": anger,
        "emo_sadness": draw.random(n), "emo_joy": np.where(draw.random(n) < 0.7, 0, draw.random(n)), "review_length": draw.integers(10, 500, n),
        "is_silent_killer": (anger + draw.normal(0, 0.15, n)) > 0.85,
    })
    table = churn.training_table(spark.createDataFrame(frame))
    return churn.stratified_split(churn.stratified_folds(table)).cache()


def single_process(frame, features, edges, training, rounds, depth, step):
    """Margins after each row's leaves, one model, no row or feature draws: plain loops over rows and nodes."""
    codes = np.array([np.searchsorted(e, frame[f].to_numpy(float), side="left") for f, e in zip(features, edges)])
    y, used = frame["label"].to_numpy(), frame[training].to_numpy()
    weight = np.where(y > 0, ((y == 0) & used).sum() / ((y == 1) & used).sum(), 1.0)
    margin = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        added = np.zeros(len(y))

        def grow(members, level):
            own = members & used
            total_g, total_h = g[own].sum(), h[own].sum()
            best = (1e-9, None, None)
            if level < depth:
                for f in range(len(features)):
                    for b in range(len(edges[f])):
                        left = own & (codes[f] <= b)
                        lg, lh = g[left].sum(), h[left].sum()
                        rg, rh = total_g - lg, total_h - lh
                        if lh < 1 or rh < 1:
                            continue
                        gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - total_g**2 / (total_h + 1)
                        if gain > best[0] + 1e-7:
                            best = (gain, f, b)
            if best[1] is None:
                added[members] = -step * total_g / (total_h + 1)
            else:
                grow(members & (codes[best[1]] <= best[2]), level + 1)
                grow(members & (codes[best[1]] > best[2]), level + 1)

        grow(np.ones(len(y), bool), 0)
        margin += added
    return 1 / (1 + np.exp(-margin))


def test_rounds_equal_a_single_process(spark, rows):
    features = list(churn.fixed.CHURN_FEATURES)
    booster = boosting.GBTClassifier(featuresCol=features, maxIter=4, maxDepth=3, stepSize=0.3, subsamplingRate=1.0, featureSubsetStrategy=1.0, maxBins=12)
    model = booster.fit(rows, [~F.col("is_test"), F.col("fold") != 1])
    got = model.transform(rows, 0, "first")
    got = model.transform(got, 1, "second").toPandas()
    got["train"], got["apart"] = ~got["is_test"], got["fold"] != 1
    for name, training in (("first", "train"), ("second", "apart")):
        want = single_process(got, features, model.edges, training, 4, 3, 0.3)
        assert np.abs(got[name] - want).max() < 1e-4


def test_trees_do_not_rest_on_partitions(spark, rows, monkeypatch):
    fit = lambda df: churn.fit_together(df, [~F.col("is_test"), F.col("fold") != 0], trees=6)
    one = fit(rows)
    monkeypatch.setattr(boosting, "CELLS", 200)
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    other = fit(rows.repartition(9))
    for a, b in zip(one.rounds, other.rounds, strict=True):
        assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and (a.value == b.value).all()


def test_as_good_as_sparks_own_trainer(spark, rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    train, test = rows.where("NOT is_test"), rows.where("is_test")
    own = ranking.auroc(churn.predict_churn(test, churn.fit_churn(train, trees=40)), "churn_risk_score", "label").first()["auroc"]
    spark_model = Pipeline(stages=[
        VectorAssembler(inputCols=list(churn.fixed.CHURN_FEATURES), outputCol="x"),
        GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=40, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, seed=42),
    ]).fit(churn.class_weights(train))
    theirs = spark_model.transform(test).select("label", vector_to_array("probability")[1].alias("p"))
    assert own > ranking.auroc(theirs, "p", "label").first()["auroc"] - 0.02


def test_folds_are_trained_together_and_scored_apart(spark, rows):
    got = churn.cross_validate(rows, trees=25).toPandas()
    assert sorted(got["fold"]) == [0, 1, 2, 3, 4]
    assert got["mean_auroc"].nunique() == 1 and got["mean_auroc"].iloc[0] == pytest.approx(got["auroc"].mean())
    assert got["std_auroc"].iloc[0] == pytest.approx(got["auroc"].std(ddof=0))
    assert got["auroc"].min() > 0.8


def test_bins_agree_between_columns_and_arrays(spark):
    edges = [-1.5, 0.0, 0.0 + 1e-9, 2.0, 7.25]
    values = [-9.0, -1.5, -1.0, 0.0, 1e-9, 1.9, 2.0, 2.1, 7.25, 9.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(boosting.bin_column(F.col("v"), edges).alias("b")).collect()
    assert [r["b"] for r in got] == np.searchsorted(edges, values, side="left").tolist()


def test_drawn_rows_are_near_their_share():
    own = np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for size in (1, 3, 8, 50):
        drawn = boosting.drawn_rows(own, np.full(20000, size), 0.8, 1, 2)
        assert abs(drawn.mean() / size - 0.8) < 0.01 and drawn.min() >= 0 and drawn.max() <= size
        assert abs(drawn.var() - size * 0.16) < 0.05 * size


def test_one_class_or_no_row(spark, rows):
    one = churn.fit_churn(rows.where("label = 0"), trees=3)
    assert churn.predict_churn(rows.limit(5), one).where("churn_risk_score > 0.5").count() == 0
    none = churn.fit_churn(rows.limit(0), trees=3)
    assert {r["churn_risk_score"] for r in churn.predict_churn(rows.limit(5), none).collect()} == {0.5}


def test_node_table_replays_a_tree(spark, rows):
    model = churn.fit_churn(rows.where("NOT is_test"), trees=2, depth=2)
    nodes = {(r["round"], r["node"]): r for r in model.node_table(spark).collect()}
    scored = churn.predict_churn(rows.limit(50), model).collect()
    for r in scored:
        margin = 0.0
        for tree in range(2):
            at = 0
            while (tree, at) in nodes and nodes[tree, at]["feature"] is not None:
                at = 2 * at + 1 + (float(r[nodes[tree, at]["feature"]]) > nodes[tree, at]["up_to"])
            margin += nodes[tree, at]["adds"] if (tree, at) in nodes else 0.0
        assert 1 / (1 + np.exp(-margin)) == pytest.approx(r["churn_risk_score"])
