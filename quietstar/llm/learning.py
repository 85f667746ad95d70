"""Bounded learning samples and a small logistic calibration, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def learning_rows(
    docs: DataFrame, labels: DataFrame, target: str, learnable: Column, bound: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``text``, ``label`` (0 or 1) of about ``bound`` labelled rows, drawn by a hash of the id.

    ``learnable`` is a condition on the column ``id``. The drawn ids are broadcast: there are ``bound`` of them whatever the
    input. Labels without a value are left out; of repeated ids the larger label counts.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(target).cast("int").alias("label")).where("label IS NOT NULL AND id IS NOT NULL")
    marks = marks.where(learnable).groupBy("id").agg(F.max("label").alias("label"))
    total = marks.count()
    share = min(1.0, bound / max(total, 1))
    drawn = marks.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "id")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> dict[str, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised columns; classes weigh the same.

    With no rows the score is one half; with one class it leans to that class.
    """
    x = np.asarray(x, float)
    x = x.reshape(len(y), x.shape[-1])
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(0) + 1e-9 if len(x) else np.ones(x.shape[1])
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)) * max(len(y), 1)
    beta, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - penalty * beta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "beta": beta}


def predict_logistic(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = (np.asarray(x, float) - model["mean"]) / model["scale"]
    return 1 / (1 + np.exp(-np.clip(model["beta"][0] + z @ model["beta"][1:], -30, 30)))
