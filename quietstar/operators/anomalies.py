"""Unusual months: isolation forest and a robust companion score.

Both run on monthly rows, so a product's group is its calendar (a few hundred rows), not its reviews.

The forest is grown for all products and trees together: a month stands once in each tree of its product, and each level of all
trees is one window over (product, tree, node), for which the rows are laid out once. Trees are independent rows, so no product is
bound to one task. Draws are hashes of product, tree and node: the same months give the same forest in any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranking

FEATURES = ("mean_sentiment", "sk_rate", "urgency", "review_count")
EULER = 0.5772156649015329


def average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` points."""
    m = F.greatest(n, F.lit(3)).cast("double")
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(m - 1) + EULER) - 2 * (m - 1) / m)


def draw(*parts: Column) -> Column:
    """A number from 0 up to 1 from a hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _values(features: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)]


def grow_forest(
    monthly: DataFrame, features: Sequence[str] = FEATURES, by: Sequence[str] = ("product_id",), trees: int = 200, sample: int = 256, seed: int = 42,
) -> DataFrame:
    """A row per month and tree: ``tree``, ``_size`` (months the tree is grown from, at most ``sample``), ``depth`` at which the
    month is isolated, and ``path``: its nodes as (node, feature, cut, n), a leaf having no feature."""
    keys = [F.col(c) for c in by]
    per_product, per_tree = W.partitionBy(*keys), W.partitionBy(*keys, "tree")
    rows = monthly.select(*keys, "month", *_values(features)).withColumn("_n", F.count(F.lit(1)).over(per_product))
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).repartition(*keys, "tree")
    place = F.row_number().over(per_tree.orderBy(F.xxhash64(*keys, "tree", "month", F.lit(seed)), "month"))
    rows = rows.withColumn("_drawn", (F.col("_n") <= sample) | (place <= sample)).withColumn("_size", F.least(F.col("_n"), F.lit(sample)))
    rows = rows.withColumns({"_node": F.lit(0).cast("long"), "depth": F.lit(None).cast("double"), "path": F.array().cast("array<struct<node:bigint,feature:int,cut:double,n:bigint>>")})
    limit = F.ceil(F.log2(F.greatest("_size", F.lit(2)).cast("double")))
    own = range(len(features))
    for level in range(math.ceil(math.log2(max(sample, 2))) + 1):
        in_node = W.partitionBy(*keys, "tree", "_node")
        seen = lambda f, c: f(F.when(F.col("_drawn"), F.col(c))).over(in_node)
        rows = rows.withColumns({"_count": F.count_if("_drawn").over(in_node)} | {f"_lo{i}": seen(F.min, f"_x{i}") for i in own} | {f"_hi{i}": seen(F.max, f"_x{i}") for i in own})
        luck = [F.when(F.col(f"_hi{i}") > F.col(f"_lo{i}"), draw(*keys, F.col("tree"), F.col("_node"), F.lit(i), F.lit(seed))).otherwise(-1.0) for i in own]
        best = F.greatest(*luck) if len(luck) > 1 else luck[0]
        rows = rows.withColumn("_best", best)
        feature = F.coalesce(*[F.when(x == F.col("_best"), F.lit(i)) for i, x in enumerate(luck)])
        leaf = (F.col("_count") <= 1) | (F.col("_best") < 0) | (F.lit(level) >= limit)
        rows = rows.withColumns({"_feature": F.when(~leaf, feature), "_done": F.col("depth").isNotNull()})
        pick = lambda prefix: F.coalesce(*[F.when(F.col("_feature") == i, F.col(f"{prefix}{i}")) for i in own])
        cut = pick("_lo") + draw(*keys, F.col("tree"), F.col("_node"), F.lit(-1), F.lit(seed)) * (pick("_hi") - pick("_lo"))
        rows = rows.withColumns({"_cut": cut, "_value": pick("_x")})
        step = F.struct(F.col("_node").alias("node"), F.col("_feature").alias("feature"), F.col("_cut").alias("cut"), F.col("_count").alias("n"))
        rows = rows.withColumns({
            "path": F.when(F.col("_done"), F.col("path")).otherwise(F.array_append("path", step)),
            "depth": F.when(~F.col("_done") & F.col("_feature").isNull(), level + average_path(F.col("_count"))).otherwise(F.col("depth")),
            "_node": F.when(F.col("_done") | F.col("_feature").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + 1 + (F.col("_value") > F.col("_cut")).cast("long")),
        })
    return rows.select(*by, "month", "tree", "_size", "depth", "path")


def forest_nodes(grown: DataFrame, by: Sequence[str] = ("product_id",)) -> DataFrame:
    """The forest as a table of nodes: keys, ``tree``, ``_size``, ``node`` (children of ``i`` are ``2i+1`` and ``2i+2``), ``feature``
    and ``cut``, or ``n`` months in a leaf."""
    return grown.select(*by, "tree", "_size", F.explode("path").alias("p")).select(*by, "tree", "_size", "p.*").distinct()


def route(months: DataFrame, nodes: DataFrame, features: Sequence[str] = FEATURES, by: Sequence[str] = ("product_id",), levels: int = 8) -> DataFrame:
    """``depth`` at which a stored forest isolates each of ``months``, per tree, by a join for each level."""
    roots = nodes.where("node = 0").select(*by, "tree", "_size")
    rows = months.select(*by, "month", *_values(features)).join(roots, list(by)).withColumns({"_node": F.lit(0).cast("long"), "depth": F.lit(None).cast("double")})
    table = nodes.select(*by, "tree", F.col("node").alias("_node"), "feature", "cut", "n")
    for level in range(levels + 1):
        rows = rows.join(table, [*by, "tree", "_node"], "left")
        value = F.coalesce(*[F.when(F.col("feature") == i, F.col(f"_x{i}")) for i in range(len(features))])
        # A side that no month of the forest went to has no node: a leaf of none.
        ends = F.col("depth").isNull() & F.col("feature").isNull()
        rows = rows.withColumns({
            "depth": F.when(ends, level + average_path(F.coalesce("n", F.lit(0)))).otherwise(F.col("depth")),
            "_node": F.when(F.col("feature").isNull(), F.lit(-1)).otherwise(2 * F.col("_node") + 1 + (value > F.col("cut")).cast("long")),
        }).drop("feature", "cut", "n")
    return rows.select(*by, "month", "tree", "_size", "depth")


def path_scores(depths: DataFrame, by: Sequence[str] = ("product_id",)) -> DataFrame:
    """``anomaly_prob`` per month: near one where trees isolate it early, one half where nothing can be told."""
    mean = depths.groupBy(*by, "month").agg(F.avg("depth").alias("_depth"), F.max("_size").alias("_size"))
    norm = average_path(F.col("_size"))
    return mean.select(*by, "month", F.when(norm > 0, F.round(F.pow(F.lit(2.0), -F.col("_depth") / norm), 9)).otherwise(0.5).alias("anomaly_prob"))


def isolation_forest(
    monthly: DataFrame, features: Sequence[str] = FEATURES, by: Sequence[str] = ("product_id",), trees: int = 200,
    contamination: float = 0.1, seed: int = 42, sample: int = 256,
) -> DataFrame:
    """Anomaly label (-1 or 1), score (higher is stranger) and flag per month of each product.

    One forest per product, each tree grown from at most ``sample`` of its months; rows are flagged when their score lies above
    the (1 - contamination) percentile of their own product.
    """
    scores = path_scores(grow_forest(monthly, features, by, trees, sample, seed), by)
    bar = F.percentile("anomaly_prob", F.lit(1 - contamination)).over(W.partitionBy(*by))
    flagged = scores.withColumn("is_anomaly", F.col("anomaly_prob") > bar)
    out = monthly.join(flagged, [*by, "month"])
    return out.select(
        *[monthly[c] for c in monthly.columns], F.when(F.col("is_anomaly"), -1).otherwise(1).alias("anomaly_score"), "anomaly_prob", "is_anomaly"
    )


def robust_anomaly(
    monthly: DataFrame, features: Sequence[str] = FEATURES, by: Sequence[str] = ("product_id",), bar: float = 3.5
) -> DataFrame:
    """Largest median/MAD z-score over the features; a reproducible check on the forest."""
    centre = monthly.groupBy(*by).agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in features])
    away = monthly.join(centre, list(by))
    spread = away.groupBy(*by).agg(
        *[F.percentile(F.abs(F.col(c) - F.col(f"_m_{c}")), F.lit(0.5)).alias(f"_d_{c}") for c in features]
    )
    scores = [
        F.coalesce(F.try_divide(F.abs(F.col(c) - F.col(f"_m_{c}")) * 0.6745, F.col(f"_d_{c}")), F.lit(0.0)) for c in features
    ]
    return (
        away.join(spread, list(by))
        .withColumn("robust_z", F.greatest(*scores))
        .withColumn("is_anomaly", F.col("robust_z") > bar)
        .select(*monthly.columns, "robust_z", "is_anomaly")
    )


def top_anomalies(scored: DataFrame, n: int = 3, by: Sequence[str] = ("product_id",)) -> DataFrame:
    order = [F.desc(F.round("anomaly_prob", 9)), F.asc("month")]
    return ranking.top_per_group(scored.filter("is_anomaly"), by, order, n)
