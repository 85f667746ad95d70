"""Topics, quotes, embeddings and the sentiment model on small English texts."""

import math

import pytest
from pyspark.sql import functions as F

from quietstar.operators import aspects, search, sentiment

BATTERY = ["battery drains fast charge dead", "battery charge fails dead power", "battery dead charge power drains"]
SOUND = ["sound bass audio crisp volume", "bass sound volume audio rich", "audio sound crisp bass rich"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, "p", body, "Battery" if body in BATTERY else "Sound") for i, body in enumerate((BATTERY + SOUND) * 10)]
    rows.append((60, "p", "zebra quartz violin meadow lantern", "Sound"))
    return spark.createDataFrame(rows, "review_id long, product_id string, clean_text string, topic_label string").withColumn(
        "review_text", F.col("clean_text")
    ).cache()


def test_topics_separate_and_small_clusters_become_outliers(texts):
    _, assigned = aspects.fit_topics(texts, k=3, min_size=5)
    cells = assigned.filter("topic_id <> -1").groupBy("topic_id").agg(F.countDistinct("topic_label").alias("labels"), F.count("*").alias("n")).collect()
    assert cells and all(c["n"] >= 5 for c in cells)
    assert assigned.count() == texts.count()


def test_quotes_are_ranked_and_central(texts):
    got = aspects.representative_quotes(texts, k=3).toPandas()
    for _, part in got.groupby("topic_label"):
        part = part.sort_values("quote_rank")
        assert list(part["quote_rank"]) == [1, 2, 3]
        assert part["centrality"].is_monotonic_decreasing
    assert not got["quote_text"].str.contains("zebra").any()


def test_embeddings_are_unit_vectors_and_find_their_own_text(texts):
    model = search.fit_embedder(texts)
    index = search.embed(texts, model)
    norms = [math.sqrt(sum(x * x for x in r["embedding"])) for r in index.collect()]
    assert norms == pytest.approx([1.0] * len(norms), abs=1e-6)
    asked = texts.sparkSession.createDataFrame([(1, "zebra lantern"), (2, "bass audio")], "query_id long, clean_text string")
    queries = search.embed(asked, model).select("query_id", F.col("embedding").alias("q"))
    best = {r["query_id"]: r["review_id"] for r in search.semantic_search(index, queries, 1, key="review_id").collect()}
    assert best[1] == 60
    assert texts.filter(F.col("review_id") == best[2]).first()["topic_label"] == "Sound"


def test_sentiment_model_learns_weak_labels(spark):
    rows = [("great love perfect", 5.0), ("awful broken refund", 1.0), ("okay average fine", 3.0)] * 20
    df = spark.createDataFrame(rows, "review_text string, star_rating double")
    scored = sentiment.apply_sentiment(df, sentiment.fit_sentiment(df, features=1 << 10))
    means = {r["star_rating"]: r["m"] for r in scored.groupBy("star_rating").agg(F.avg("sentiment_score").alias("m")).collect()}
    assert means[5.0] > means[3.0] > means[1.0]
    assert scored.filter("abs(prob_negative + prob_neutral + prob_positive - 1) > 1e-9").count() == 0


def test_projection_separates_the_groups(texts):
    got = aspects.project_2d(texts.filter("review_id < 60"), vocabulary=50).select("topic_label", "x", "y").toPandas()
    means = got.groupby("topic_label")[["x", "y"]].mean()
    assert ((means.loc["Battery"] - means.loc["Sound"]) ** 2).sum() > 0.1
