"""Churn-risk classifier on features that cannot re-derive the label, and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, maths
from . import ranking
from .boosting import BoostedModel, GBTClassifier

LABEL = "is_silent_killer"


def training_table(df: DataFrame, features: Sequence[str] = fixed.CHURN_FEATURES, label: str = LABEL) -> DataFrame:
    """review_id, numeric features and a 0/1 label; rows with any null are left out."""
    out = df
    if "review_length" in features and "review_length" not in df.columns:
        out = out.withColumn("review_length", F.length("review_text"))
    return out.select(
        "review_id",
        *[F.col(c).cast("double").alias(c) for c in features],
        F.col(label).cast("int").cast("double").alias("label"),
    ).na.drop()


def class_positions(df: DataFrame, seed: int | str = 42) -> DataFrame:
    """``position`` and ``group_size`` of every row in its class, in digest order."""
    return ranking.digest_positions(df, ["label"], maths.seeded_key(F.col("review_id"), seed), "review_id")


def stratified_split(df: DataFrame, test_share: float = 0.2, seed: int | str = 42) -> DataFrame:
    """``is_test`` for the first ``floor(share * size)`` rows of each class in digest order."""
    placed = class_positions(df, seed)
    return placed.withColumn("is_test", F.col("position") <= F.floor(F.col("group_size") * test_share)).drop(
        "position", "group_size"
    )


def fold_count(df: DataFrame, k: int = 5) -> DataFrame:
    """max(2, min(k, positives, negatives))."""
    return df.agg(
        F.greatest(
            F.lit(2), F.least(F.lit(k), F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0))
        ).cast("bigint").alias("k")
    )


def stratified_folds(df: DataFrame, k: int = 5, seed: int | str = 42) -> DataFrame:
    """Fold number per row, dealt round-robin inside each class."""
    folds = ranking.one_value(fold_count(df, k), "k")
    return class_positions(df, seed).withColumn("fold", (F.col("position") - 1) % folds).drop("position", "group_size")


def class_weights(df: DataFrame) -> DataFrame:
    """``weight`` = negatives / positives on positive rows, 1 elsewhere."""
    balance = df.agg(
        F.coalesce(
            F.try_divide(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)), F.lit(1.0)
        ).alias("w")
    )
    return df.withColumn("weight", F.when(F.col("label") == 1, ranking.one_value(balance, "w")).otherwise(1.0))


def fit_together(
    df: DataFrame, training: Sequence[Column], features: Sequence[str] = fixed.CHURN_FEATURES, trees: int = 300, depth: int = 5,
    step: float = 0.05, seed: int = 42,
) -> BoostedModel:
    """One model of boosted trees for each condition in ``training``, all in one training; each is weighted by the class balance of
    its own training rows."""
    booster = GBTClassifier(
        featuresCol=list(features), labelCol="label", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8,
        featureSubsetStrategy=0.8, seed=seed,
    )
    return booster.fit(df, training)


def fit_churn(train: DataFrame, features: Sequence[str] = fixed.CHURN_FEATURES, **fit: float) -> BoostedModel:
    return fit_together(train, [F.lit(True)], features, **fit)


def predict_churn(df: DataFrame, model: BoostedModel, number: Column | int = 0) -> DataFrame:
    """Score and label of each row by the model of that ``number``."""
    scored = model.transform(df, number, "churn_risk_score")
    return scored.withColumn("churn_risk_label", (F.col("churn_risk_score") > 0.5).cast("int"))


def attach_predictions(df: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions back on every review by id; rows that were not scored get zero."""
    scores = predictions.select("review_id", "churn_risk_score", "churn_risk_label")
    return df.join(scores, "review_id", "left").na.fill(0, ["churn_risk_score", "churn_risk_label"])


def feature_importance(model: BoostedModel, number: int = 0) -> DataFrame:
    """Share of the gain of all splits by feature."""
    from pyspark.sql import SparkSession

    frame = SparkSession.active().createDataFrame(list(model.importances(number).items()), "feature string, importance double")
    return frame.orderBy(F.desc("importance"), F.asc("feature"))


def classification_metrics(df: DataFrame, label: str = "label", predicted: str = "churn_risk_label") -> DataFrame:
    """Confusion counts, precision, recall and F1 with zero for an empty denominator, in one pass."""
    y, p = F.col(label).cast("int") == 1, F.col(predicted).cast("int") == 1
    counts = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("n", tp + fp + fn + F.col("tn"))
        .withColumn("positive_pct", maths.ratio((tp + fn) * 100.0, F.col("n")))
        .withColumn("precision", maths.ratio(tp, tp + fp))
        .withColumn("recall", maths.ratio(tp, tp + fn))
        .withColumn("f1", maths.ratio(2.0 * tp, 2 * tp + fp + fn))
    )


def fold_numbers(folded: DataFrame) -> list[int]:
    return [r[0] for r in folded.select("fold").distinct().orderBy("fold").collect()]


def fold_scores(folded: DataFrame, folds: Sequence[int], model: BoostedModel, first: int = 0) -> DataFrame:
    """AUROC of each fold under the model that did not learn from it, with the mean and the population deviation over them.

    The model of the first of ``folds`` has the number ``first``.
    """
    number = F.array_position(F.array(*[F.lit(f).cast("long") for f in folds]), F.col("fold").cast("long")) - 1 + first
    scores = ranking.auroc(predict_churn(folded, model, number), "churn_risk_score", "label", ["fold"]).select("fold", "auroc")
    everything = W.partitionBy(F.lit(0))
    return scores.withColumn("mean_auroc", F.avg("auroc").over(everything)).withColumn(
        "std_auroc", F.stddev_pop("auroc").over(everything)
    )


def cross_validate(
    df: DataFrame, features: Sequence[str] = fixed.CHURN_FEATURES, k: int = 5, seed: int = 42, **fit: float
) -> DataFrame:
    """AUROC per fold, every fold of the table, with the mean and the population deviation over them. ``k`` folds are made
    where the table has none.

    The models of all folds are trained together. The fold table should be cached or written by the caller: it is read three times.
    """
    folded = df if "fold" in df.columns else stratified_folds(df, k, seed)
    folds = fold_numbers(folded)
    model = fit_together(folded, [F.col("fold") != f for f in folds], features, seed=seed, **fit)
    return fold_scores(folded, folds, model)


def leakage_audit(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    """AUROC of each feature alone, and whether it may be used.

    A feature leaks when it belongs to the label's formula or separates the classes perfectly, either
    way round.
    """
    pairs = df.select(
        F.col(label).cast("int").alias("label"),
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features
        ])).alias("p"),
    ).select("label", "p.feature", "p.value")
    scores = ranking.auroc(pairs, "value", "label", ["feature"])
    in_formula = F.col("feature").isin(*fixed.LABEL_FORMULA_COLUMNS)
    perfect = F.coalesce(F.greatest("auroc", 1 - F.col("auroc")) >= 0.999, F.lit(False))
    return scores.select("feature", "auroc", in_formula.alias("in_label_formula"), (in_formula | perfect).alias("leaks"))
