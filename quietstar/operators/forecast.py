"""Cubic ridge trend of monthly sentiment with a bootstrap interval, in column expressions.

A product is one row with the array of its months. A fit is a few folds over that array and an elimination over columns; a
resample is the same fit over months picked by digests, so any engine that knows MD5 draws the same ones. Nothing is multiplied
but the product rows, once for each resample, and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEGREE = 3


def _powers(x: Column, degree: int) -> list[Column]:
    out = [x]
    for _ in range(1, degree):
        out.append(out[-1] * x)
    return out


def _total(points: str, value) -> Column:
    """Sum over an array of points in its order, so that it comes out the same everywhere."""
    return F.aggregate(points, F.lit(0.0), lambda acc, p: acc + value(p))


def fit(df: DataFrame, points: str, degree: int = DEGREE, alpha: float = 10.0) -> DataFrame:
    """Adds the ridge fit over an array of (x, y): means ``m0`` (of y), ``m1``.. (of the powers) and slopes ``k1``...

    x is scaled by the column ``scale`` and the penalty by the same factor, so predictions are those on raw powers; the intercept
    is not penalised. Powers are centred before they are multiplied, and the system is solved by elimination.
    """
    powers = range(1, degree + 1)
    n = F.size(points)
    df = df.withColumns({"m0": _total(points, lambda p: p["y"]) / n} | {f"m{i}": _total(points, lambda p, i=i: _powers(p["x"], i)[-1]) / n for i in powers})
    away = lambda p, i: _powers(p["x"], i)[-1] - F.col(f"m{i}")
    sums = {f"a{i}{j}": _total(points, lambda p, i=i, j=j: away(p, i) * away(p, j)) for i in powers for j in powers if j >= i}
    df = df.withColumns(sums | {f"b{i}": _total(points, lambda p, i=i: away(p, i) * (p["y"] - F.col("m0"))) for i in powers})
    df = df.withColumns({f"a{i}{i}": F.col(f"a{i}{i}") + F.lit(alpha) / _powers(F.col("scale"), 2 * i)[-1] for i in powers})
    for i in powers:
        for j in range(i + 1, degree + 1):
            share = F.try_divide(F.col(f"a{i}{j}"), F.col(f"a{i}{i}"))
            rest = {f"a{j}{k}": F.col(f"a{j}{k}") - F.col("share") * F.col(f"a{i}{k}") for k in range(j, degree + 1)}
            df = df.withColumn("share", share).withColumns(rest | {f"b{j}": F.col(f"b{j}") - F.col("share") * F.col(f"b{i}")})
    for i in reversed(powers):
        left = F.col(f"b{i}")
        for j in range(i + 1, degree + 1):
            left = left - F.col(f"a{i}{j}") * F.col(f"k{j}")
        df = df.withColumn(f"k{i}", F.coalesce(F.try_divide(left, F.col(f"a{i}{i}")), F.lit(0.0)))
    used = [f"a{i}{j}" for i in powers for j in powers if j >= i] + [f"b{i}" for i in powers]
    return df.drop(*used, "share")


def fitted_at(x: Column, degree: int = DEGREE) -> Column:
    out = F.col("m0")
    for i, power in enumerate(_powers(x, degree), 1):
        out = out + F.col(f"k{i}") * (power - F.col(f"m{i}"))
    return out


def product_months(monthly: DataFrame, by: Sequence[str] = ("product_id",), min_months: int = 6) -> DataFrame:
    """A row per product of enough months: ``points`` (month, x, y), ``scale``, ``t_last`` and ``last_month``.

    Means are rounded at the ninth digit, so that resamples agree between engines that add in another order.
    """
    per_product = W.partitionBy(*by)
    day = F.datediff("month", F.min("month").over(per_product)).cast("double")
    placed = monthly.select(*by, "month", "mean_sentiment", day.alias("t")).withColumn("scale", F.greatest(F.max("t").over(per_product), F.lit(1.0)))
    point = F.struct("month", (F.col("t") / F.col("scale")).alias("x"), F.round("mean_sentiment", 9).alias("y"))
    rows = placed.groupBy(*by).agg(
        F.sort_array(F.collect_list(point)).alias("points"), F.max("scale").alias("scale"), F.max("t").alias("t_last"), F.max("month").alias("last_month")
    )
    return rows.where(F.size("points") >= min_months)


def _ahead(step: Column) -> Column:
    """Scaled position of a future month: positions step by 30 days while labels are month ends."""
    return (F.col("t_last") + 30 * step) / F.col("scale")


def bootstrap_interval(
    monthly: DataFrame, by: Sequence[str] = ("product_id",), degree: int = DEGREE, alpha: float = 10.0, horizon: int = 6, min_months: int = 6,
    resamples: int = 500, seed: int | str = 42,
) -> DataFrame:
    """5% and 95% bounds of the fits over ``resamples`` of each product's months, per step ahead.

    Resample ``r`` picks its ``j``-th month by the first eight hex digits of ``md5(product|r|j|seed)`` modulo the number of months.
    """
    keys = [F.col(c).cast("string") for c in by]
    rows = product_months(monthly, by, min_months).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))

    def picked(j: Column) -> Column:
        digest = F.md5(F.concat_ws("|", *keys, F.col("r").cast("string"), j.cast("string"), F.lit(str(seed))))
        return F.get("points", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.size("points")).cast("int"))

    rows = rows.withColumn("picks", F.transform(F.sequence(F.lit(0), F.size("points") - 1), picked))
    fits = fit(rows.drop("points"), "picks", degree, alpha).select(*by, "r", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "t_last", "scale", *[f"m{i}" for i in range(degree + 1)], *[f"k{i}" for i in range(1, degree + 1)])
    values = fits.select(*by, "step", fitted_at(_ahead(F.col("step")), degree).alias("value"))
    bounds = values.groupBy(*by, "step").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("ci"))
    return bounds.select(*by, "step", F.col("ci")[0].alias("ci_lo"), F.col("ci")[1].alias("ci_hi"))


def forecast(
    monthly: DataFrame, by: Sequence[str] = ("product_id",), degree: int = DEGREE, alpha: float = 10.0, horizon: int = 6,
    min_months: int = 6, resamples: int = 500, seed: int | str = 42, interval: bool = True,
) -> DataFrame:
    """Fitted history and ``horizon`` future months per product, with a 5-95% interval and direction.

    Future x positions step by 30 days while labels are true month ends, as published. Products with
    fewer than ``min_months`` months yield no rows. Without ``interval`` its bounds are null and nothing is resampled.
    """
    keys = list(by)
    rows = fit(product_months(monthly, by, min_months), "points", degree, alpha)
    ends = [fitted_at(_ahead(F.lit(step)), degree) for step in (1, horizon)]
    rows = rows.withColumn("direction", F.when(ends[1] > ends[0], F.lit("improving")).otherwise(F.lit("declining")))
    known = F.transform("points", lambda p: F.struct(F.lit(0).alias("step"), p["month"].alias("month"), p["x"].alias("x"), p["y"].alias("actual")))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.struct(
        i.alias("step"), F.last_day(F.add_months("last_month", i)).alias("month"), _ahead(i).alias("x"), F.lit(None).cast("double").alias("actual")
    ))
    rows = rows.withColumn("p", F.explode(F.concat(known, ahead)))
    out = rows.select(*keys, "p.step", "p.month", "p.actual", fitted_at(F.col("p.x"), degree).alias("fitted"), (F.col("p.step") > 0).alias("is_forecast"), "direction")
    if interval:
        out = out.join(bootstrap_interval(monthly, by, degree, alpha, horizon, min_months, resamples, seed), [*keys, "step"], "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("ci_lo", "ci_hi")})
    return out.select(*keys, "month", "actual", "fitted", "ci_lo", "ci_hi", "is_forecast", "direction")


def sufficient_stats(monthly: DataFrame, by: Sequence[str] = ("product_id",), degree: int = DEGREE) -> DataFrame:
    """Sums of scaled powers and cross products per product: all a cubic fit needs."""
    per_product = W.partitionBy(*by)
    day = F.datediff("month", F.min("month").over(per_product)).cast("double")
    placed = monthly.withColumn("_t", day).withColumn("_s", F.greatest(F.max("_t").over(per_product), F.lit(1.0)))
    x = F.col("_t") / F.col("_s")
    sums = [F.sum(F.pow(x, F.lit(float(p)))).alias(f"s{p}") for p in range(1, 2 * degree + 1)]
    cross = [F.sum(F.pow(x, F.lit(float(p))) * F.col("mean_sentiment")).alias(f"sy{p}") for p in range(0, degree + 1)]
    return placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("_s").alias("scale"), *sums, *cross)
