"""Metrics of the model suite in one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import anomalies, churn, forecast, ranking, trend
from ..session import read_back


def ml_metrics(labelled: DataFrame, index: DataFrame, trees: int = 300, folds: int = 5) -> DataFrame:
    """One row: churn scores and cross-validation, anomaly counts, forecast availability, index size."""
    spark = labelled.sparkSession
    folded = churn.stratified_folds(churn.training_table(labelled), k=folds)
    table = read_back(spark, churn.stratified_split(folded), "churn-table")
    numbers = churn.fold_numbers(table)
    # The final model is number 0; those of the folds follow, all of one training.
    training = [~F.col("is_test"), *[F.col("fold") != f for f in numbers]]
    model = churn.fit_together(table, training, trees=trees)
    train, test = table.filter(~F.col("is_test")), table.filter("is_test")
    scored = read_back(spark, churn.predict_churn(test, model), "churn-test")
    metrics = churn.classification_metrics(scored)
    cv = churn.fold_scores(table, numbers, model, first=1).agg(
        F.max("mean_auroc").alias("cv_auroc_mean"), F.max("std_auroc").alias("cv_auroc_std")
    )
    monthly = read_back(spark, trend.monthly_metrics(labelled), "monthly")
    odd = anomalies.isolation_forest(monthly).agg(
        F.count(F.lit(1)).alias("n_months"), F.count_if("is_anomaly").alias("n_anomalies")
    )
    line = forecast.forecast(monthly).agg(F.count_if("is_forecast").alias("n_forecast_rows"))

    def one(df: DataFrame, column: str):
        return ranking.one_value(df, column)

    return metrics.select(
        F.lit("gradient boosted trees").alias("model_name"),
        F.lit(",".join(fixed.CHURN_FEATURES)).alias("features"),
        one(train.agg(F.count(F.lit(1)).alias("n")), "n").alias("n_train"),
        F.col("n").alias("n_test"),
        F.round(one(ranking.auroc(scored, "churn_risk_score", "label"), "auroc"), 4).alias("auroc"),
        F.round("f1", 4).alias("f1"), F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"),
        "tp", "fp", "fn", "tn",
        F.round(one(cv, "cv_auroc_mean"), 4).alias("cv_auroc_mean"),
        F.round(one(cv, "cv_auroc_std"), 4).alias("cv_auroc_std"),
        F.lit(churn.feature_importance(model).first()["feature"]).alias("top_feature"),
        one(odd, "n_months").alias("n_months_analyzed"), one(odd, "n_anomalies").alias("n_anomalies"),
        one(line, "n_forecast_rows").alias("n_forecast_rows"),
        one(index.agg(F.count(F.lit(1)).alias("n")), "n").alias("n_indexed"),
    )
