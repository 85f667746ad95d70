"""The isolation forest against a single-process forest on the same draws, and its node table."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietstar.operators import anomalies

SCHEMA = "product_id string, month date, mean_sentiment double, sk_rate double, urgency double, review_count long"
TREES, SAMPLE = 6, 16


@pytest.fixture(scope="module")
def monthly(spark):
    draw, rows = np.random.default_rng(4), []
    for product, n in (("a", 50), ("b", 12), ("c", 1), ("same", 5)):
        for i in range(n):
            value = 1.0 if product == "same" else float(draw.normal())
            urgency = None if product == "b" and i == 3 else float(draw.integers(0, 4)) * (product != "same")
            rows.append((product, dt.date(2015 + i // 12, i % 12 + 1, 28), value, value * 2, urgency, 3 if product == "same" else int(draw.integers(3, 60))))
    return spark.createDataFrame(rows, SCHEMA).cache()


def draws(spark, product):
    """Every draw a tree of the product can ask for, and the order in which its months are picked."""
    nodes = spark.range(2 ** 6).select(F.lit(product).alias("product_id"), F.col("id").alias("node")).crossJoin(spark.range(TREES).select(F.col("id").cast("int").alias("tree")))
    asked = nodes.select("tree", "node", *[anomalies.draw(F.col("product_id"), F.col("tree"), F.col("node"), F.lit(i), F.lit(42)).alias(f"d{i}") for i in (-1, 0, 1, 2, 3)])
    return {(r["tree"], r["node"]): [r["d0"], r["d1"], r["d2"], r["d3"], r["d-1"]] for r in asked.collect()}


def depth_of(x, cut_points, sample, limit, luck, tree):
    """Depth of point ``x`` in the tree that the sample gives: plain recursion over lists."""
    node, level, members = 0, 0, sample
    while True:
        spans = [(min(m[i] for m in members), max(m[i] for m in members)) if members else (0, 0) for i in range(4)]
        usable = [i for i in range(4) if spans[i][1] > spans[i][0]]
        if len(members) <= 1 or not usable or level >= limit:
            n = len(members)
            return level + (0 if n <= 1 else 1 if n == 2 else 2 * (math.log(n - 1) + anomalies.EULER) - 2 * (n - 1) / n)
        *by_feature, share = luck[tree, node]
        best = max(usable, key=lambda i: (by_feature[i], -i))
        cut = spans[best][0] + share * (spans[best][1] - spans[best][0])
        right = x[best] > cut
        members = [m for m in members if (m[best] > cut) == right]
        node, level = 2 * node + 1 + right, level + 1


def test_depths_equal_a_single_process(spark, monthly):
    grown = anomalies.grow_forest(monthly.repartition(5), trees=TREES, sample=SAMPLE)
    got = {(r["product_id"], r["month"], r["tree"]): r["depth"] for r in grown.collect()}
    order = monthly.select("product_id", "month", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    order = order.withColumn("h", F.xxhash64("product_id", "tree", "month", F.lit(42))).collect()
    for product in ("a", "b", "c", "same"):
        rows = {r["month"]: [r["mean_sentiment"], r["sk_rate"], r["urgency"] or 0.0, float(r["review_count"])] for r in monthly.where(F.col("product_id") == product).collect()}
        luck, size = draws(spark, product), min(len(rows), SAMPLE)
        limit = math.ceil(math.log2(max(size, 2)))
        for tree in range(TREES):
            picked = sorted((r["h"], r["month"]) for r in order if r["product_id"] == product and r["tree"] == tree)[:size]
            sample = [rows[m] for _, m in picked]
            for month, x in rows.items():
                assert got[product, month, tree] == pytest.approx(depth_of(x, None, sample, limit, luck, tree), abs=1e-9)


def test_stored_nodes_route_months_to_the_same_depths(spark, monthly):
    grown = anomalies.grow_forest(monthly, trees=TREES, sample=SAMPLE).cache()
    nodes = anomalies.forest_nodes(grown)
    assert nodes.groupBy("product_id", "tree", "node").count().where("count > 1").count() == 0
    routed = anomalies.route(monthly, nodes, levels=5)
    pair = routed.join(grown.select("product_id", "month", "tree", F.col("depth").alias("own")), ["product_id", "month", "tree"])
    assert pair.count() == grown.count() and pair.where("abs(depth - own) > 1e-12").count() == 0
    other = spark.createDataFrame([("a", dt.date(2030, 1, 31), 9.0, 9.0, 9.0, 500), ("none", dt.date(2030, 1, 31), 0.0, 0.0, 0.0, 1)], SCHEMA)
    far = anomalies.path_scores(anomalies.route(other, nodes, levels=5)).collect()
    usual = anomalies.path_scores(grown).where("product_id = 'a'").agg(F.median("anomaly_prob")).first()[0]
    assert [r["product_id"] for r in far] == ["a"] and far[0]["anomaly_prob"] > usual


def test_the_sample_is_a_parameter(monthly):
    sizes = lambda n: {r["_size"] for r in anomalies.grow_forest(monthly, trees=2, sample=n).where("product_id = 'a'").collect()}
    assert sizes(8) == {8} and sizes(256) == {50}


def test_products_that_tell_nothing(monthly):
    got = anomalies.isolation_forest(monthly, trees=5).where("product_id IN ('c', 'same')").collect()
    assert len(got) == 6 and not any(r["is_anomaly"] for r in got) and {r["anomaly_prob"] for r in got if r["product_id"] == "c"} == {0.5}
    assert anomalies.isolation_forest(monthly.limit(0), trees=2).count() == 0
