"""Stored rollups: exact sums, sketches within their errors, and updates that read new files only."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quietstar.operators import ranking, rollups, silent_killers, trend


@pytest.fixture(scope="module")
def reviews(spark):
    draw, n = np.random.default_rng(6), 30_000
    frame = pd.DataFrame({
        "review_id": np.arange(n), "product_id": np.where(draw.random(n) < 0.4, "hot", draw.choice(list("abcd"), n)),
        "review_date": [dt.date(2021, 1, 1) + dt.timedelta(days=int(d)) for d in draw.integers(0, 700, n)], "star_rating": draw.integers(1, 6, n).astype(float),
        "prob_negative": draw.beta(2, 3, n), "sentiment_score": draw.normal(size=n), "is_silent_killer": draw.random(n) < 0.1,
        "emo_anger": draw.random(n), "emo_sadness": draw.random(n), "author": draw.integers(0, 9000, n),
    })
    return spark.createDataFrame(frame).repartition(6).cache()


def test_sums_are_exact_and_sketches_within_their_error(reviews):
    rolled = rollups.roll_up(reviews, ["review_id", "author"])
    keys = ["product_id", "month"]
    got = rollups.monthly_from_rollup(rolled).orderBy(*keys).toPandas()
    want = trend.monthly_metrics(reviews).orderBy(*keys).toPandas()[got.columns.tolist()]
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)
    exact = reviews.agg(F.count_distinct("review_id").alias("review_id"), F.count_distinct("author").alias("author")).first()
    told = rollups.distinct_from_rollup(rolled).first()
    assert all(abs(told[c] / exact[c] - 1) < 3 * 1.04 / 2 ** (rollups.INDEX_BITS / 2) for c in ("review_id", "author"))
    bad = reviews.where("star_rating <= 2")
    for p in (0.1, 0.5, 0.9):
        bar = rollups.threshold_from_rollup(rolled, p).first()
        rank = bad.where(F.col("prob_negative") <= bar["threshold"]).count() / bad.count()
        assert bar["n_rows"] == bad.count() and abs(rank - p) < 0.01
    per = {r["product_id"]: r["threshold"] for r in rollups.threshold_from_rollup(rolled, by=["product_id"]).collect()}
    for r in silent_killers.sk_threshold(reviews, {"p10": 0.1}, ["product_id"]).collect():
        assert per[r["product_id"]] == pytest.approx(r["p10"], abs=0.02)


def test_updates_read_new_files_only(spark, reviews, tmp_path):
    source, store = str(tmp_path / "reviews"), str(tmp_path / "rollup")
    reviews.where("review_id % 3 = 0").coalesce(1).write.parquet(source)
    read = []

    def reader(files):
        read.append(files)
        return spark.read.schema(reviews.schema).parquet(*files)

    first = rollups.source_files(spark, source)
    assert rollups.update_rollup(spark, store, first, reader) == first
    reviews.where("review_id % 3 <> 0").coalesce(2).write.mode("append").parquet(source)
    every = rollups.source_files(spark, source)
    for f in first:  # an old file that can't be read any more
        with open(f.removeprefix("file:"), "wb") as out:
            out.write(b"gone")
        os.remove(os.path.join(os.path.dirname(f.removeprefix("file:")), f".{os.path.basename(f)}.crc"))
    new = rollups.update_rollup(spark, store, every, reader)
    assert new == [f for f in every if f not in first] and len(read) == 2
    assert rollups.update_rollup(spark, store, every, reader) == [] and len(read) == 2
    merged = rollups.merge_rollups(rollups.read_rollup(spark, store), []).first()
    assert merged["review_count"] == reviews.count() and merged["sk_count"] == reviews.where("is_silent_killer").count()
    assert rollups.monthly_from_rollup(rollups.read_rollup(spark, store)).count() == trend.monthly_metrics(reviews).count()


def test_products_without_bad_reviews_have_no_bar(reviews):
    rolled = rollups.roll_up(reviews.where("star_rating > 2 AND product_id = 'a'"))
    assert rollups.threshold_from_rollup(rolled).first()["threshold"] is None
    assert rollups.roll_up(reviews.limit(0)).count() == 0
