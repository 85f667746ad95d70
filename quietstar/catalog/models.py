"""Churn classifier, its evaluation and the metrics document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import churn, ranking
from ..plans import models
from ..session import read_back
from ..sources import adapters as A
from .common import labelled_stage, rounded
from .sql import query, rnd


def _table(spark, sf):
    return churn.training_table(labelled_stage(spark, sf))


def _marked(spark, sf):
    """The labels table as outcomes, document length in thousands as the score."""
    docs = A.table(spark, sf, "documents").select("doc_id", F.round(F.col("n_chars") / 1000.0, 1).alias("score"))
    return A.table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.col("toxic").alias("label"), "quality", "score")


def _attach(spark, sf):
    marks = A.table(spark, sf, "labels").select(
        F.col("doc_id").alias("review_id"), (F.col("toxic") * 0.5 + F.col("quality") * 0.25).alias("churn_risk_score"),
        F.col("toxic").alias("churn_risk_label"),
    )
    return churn.attach_predictions(A.reviews(spark, sf).select("review_id", "product_id"), marks)


def _folds(spark, sf):
    marks = A.table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"), F.col("toxic").alias("label"))
    return churn.stratified_folds(marks).select("review_id", "label", F.col("fold").cast("bigint").alias("fold"))


def _split_scores(spark, sf):
    split = read_back(spark, churn.stratified_split(_table(spark, sf)), "churn-split")
    model = churn.fit_churn(split.filter(~F.col("is_test")))
    return split, model


def _scores(spark, sf):
    split, model = _split_scores(spark, sf)
    everyone = labelled_stage(spark, sf).select("review_id", "product_id")
    return churn.attach_predictions(everyone, churn.predict_churn(split, model))


def _importance(spark, sf):
    return churn.feature_importance(_split_scores(spark, sf)[1])


def _cv(spark, sf):
    table = read_back(spark, churn.stratified_folds(_table(spark, sf), k=5), "churn-folds")
    return churn.cross_validate(table, k=5)


def _audit(spark, sf):
    features = ["helpful_votes", "verified_purchase", "review_length", "star_rating", "sentiment_score", "revenue_at_risk"]
    return rounded(churn.leakage_audit(labelled_stage(spark, sf), features))


QUERIES = {
    "classification_metrics": lambda s, d: rounded(churn.classification_metrics(
        _marked(s, d).withColumn("churn_risk_label", (F.col("score") >= 1.5).cast("int"))
    )),
    "auroc_rank": lambda s, d: rounded(ranking.auroc(_marked(s, d), "score", "label")),
    "attach_predictions": _attach,
    "stratified_folds": _folds,
    "leakage_audit": _audit,
    "churn_scores": _scores,
    "churn_cv": _cv,
    "feature_importance": _importance,
    "ml_metrics": lambda s, d: models.ml_metrics(labelled_stage(s, d), A.table(s, d, "embeddings")),
}

_MARKED = {"marked": "SELECT doc_id, toxic AS y, quality, round(n_chars / 1000.0::double, 1) AS v FROM labels JOIN documents USING (doc_id)"}


def _auroc(source: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    return f"""
        SELECT {keys} count(*) AS n_rows, sum(y)::bigint AS n_pos,
          (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0)::double AS a
        FROM (SELECT *, rank() OVER ({part} ORDER BY v) + (count(*) OVER (PARTITION BY {keys} v) - 1) / 2 AS r FROM {source}) GROUP BY ALL"""


_AUDIT = {
    "wide": """
        SELECT is_silent_killer::int AS y, helpful_votes::double AS helpful_votes, verified_purchase::int::double AS verified_purchase,
          length(review_text)::double AS review_length, star_rating, sentiment_score, revenue_at_risk FROM labelled""",
    "tall": "SELECT y, feature, v FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE y) INTO NAME feature VALUE v)",
    "areas": _auroc("tall", "feature, "),
}

ORACLES = {
    "classification_metrics": query(f"""
        SELECT tp, fp, fn, tn, n, {rnd("(tp + fn) * 100.0::double / n", "positive_pct")},
          {rnd("CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END", "precision")},
          {rnd("CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END", "recall")},
          {rnd("CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END", "f1")}
        FROM (SELECT count_if(y = 1 AND v >= 1.5)::bigint AS tp, count_if(y = 0 AND v >= 1.5)::bigint AS fp,
                count_if(y = 1 AND v < 1.5)::bigint AS fn, count_if(y = 0 AND v < 1.5)::bigint AS tn, count(*) AS n FROM marked)""", **_MARKED),
    "auroc_rank": query(f"SELECT n_rows, n_pos, {rnd('a', 'auroc')} FROM ({_auroc('marked')})", **_MARKED),
    "attach_predictions": query("""
        SELECT review_id, product_id, coalesce(toxic * 0.5 + quality * 0.25, 0)::double AS churn_risk_score, coalesce(toxic, 0) AS churn_risk_label
        FROM reviews LEFT JOIN labels ON doc_id = review_id"""),
    "stratified_folds": """
        SELECT doc_id AS review_id, toxic AS label,
          (row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::varchar || '42'), doc_id) - 1) % k AS fold
        FROM labels, (SELECT greatest(2, least(5, sum(toxic), sum(1 - toxic)))::bigint AS k FROM labels)""",
    "leakage_audit": query(f"""
        SELECT feature, {rnd("a", "auroc")}, feature IN ('star_rating', 'sentiment_score', 'revenue_at_risk') AS in_label_formula,
          feature IN ('star_rating', 'sentiment_score', 'revenue_at_risk') OR greatest(a, 1 - a) >= 0.999 AS leaks FROM areas""", **_AUDIT),
}
