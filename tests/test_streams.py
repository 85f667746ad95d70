"""Streams over several files give what batch gives."""

import pytest
from pyspark.sql import functions as F

from quietstar.operators import discovery
from quietstar.session import shared_dir
from quietstar.sources import adapters as A
from quietstar.streaming import arrivals


@pytest.fixture(scope="module")
def feed(spark, sf_dir):
    """The event table as four files that arrive one per trigger, in time order."""
    path = shared_dir(spark, "feed")
    events = A.table(spark, sf_dir, "events")
    parts = 4
    n = events.count()
    for i in range(parts):
        low, high = n * i // parts, n * (i + 1) // parts
        events.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(path)
    return path, events


def _stream(spark, feed):
    path, events = feed
    return A.event_reviews(arrivals.file_stream(spark, path, events.schema, max_files=1))


def test_running_counts_keep_the_newest_version(spark, feed):
    want = discovery.reviews_per_product(A.event_reviews(feed[1]))
    got = arrivals.running_counts(_stream(spark, feed))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_redelivered_reviews_are_dropped(spark, feed):
    doubled = _stream(spark, feed).unionByName(_stream(spark, feed))
    got = arrivals.dedup_stream(doubled)
    assert got.count() == feed[1].count() == got.select("review_id").distinct().count()


def test_closed_windows_equal_batch(spark, feed):
    got = arrivals.window_metrics(_stream(spark, feed))
    batch = A.event_reviews(feed[1]).groupBy(F.window("event_time", "7 days").alias("w"), "product_id").count()
    want = {(r["d"], r["product_id"]): r["count"] for r in batch.withColumn("d", F.date_format("w.start", "yyyy-MM-dd")).collect()}
    rows = got.collect()
    assert rows and all(want[(r["window_start"], r["product_id"])] == r["review_count"] for r in rows)
