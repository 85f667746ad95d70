"""Streams of arriving reviews: counts, windowed metrics, flagging and de-duplication.

Every job runs with ``availableNow`` here and leaves a table behind; on a cluster the trigger is the
caller's choice. Tables and checkpoints live under ``session.shared_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import silent_killers
from ..session import shared_dir


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, file_glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """File source with an explicit schema and an optional bound on files per trigger."""
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Append a stream to a parquet table and return a scan of it."""
    spark = stream.sparkSession
    base = shared_dir(spark, name)
    _finish(
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def running_counts(stream: DataFrame, by: str = "product_id", name: str = "counts") -> DataFrame:
    """Reviews seen so far per product; changed counts are appended per batch with its number.

    Update mode writes only the products a batch touched. The newest version of each is the result.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, name)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(
            f"{base}/table/batch={number}"
        )

    counts = stream.groupBy(by).agg(F.count(F.lit(1)).alias("review_count"))
    schema = T.StructType([*counts.schema.fields, T.StructField("batch_no", T.LongType())])
    # A stream without any batch leaves this empty version.
    spark.createDataFrame([], schema).write.parquet(f"{base}/table/batch=-1")
    _finish(
        counts.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    versions = spark.read.schema(schema).parquet(f"{base}/table/*")
    return versions.groupBy(by).agg(F.max_by("review_count", "batch_no").alias("review_count"))


def window_metrics(stream: DataFrame, window: str = "7 days", watermark: str = "1 day", name: str = "windows") -> DataFrame:
    """Tumbling event-time metrics per product; a window is written once the watermark closes it."""
    grouped = (
        stream.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", window).alias("w"), "product_id")
        .agg(
            F.count(F.lit(1)).alias("review_count"),
            F.avg("star_rating").alias("avg_star"),
            F.avg(F.col("prob_positive") - F.col("prob_negative")).alias("avg_sentiment"),
        )
    )
    flat = grouped.select(
        F.date_format("w.start", "yyyy-MM-dd").alias("window_start"), "product_id", "review_count", "avg_star", "avg_sentiment"
    )
    return to_table(flat, name)


def flag_stream(stream: DataFrame, thresholds: DataFrame, name: str = "flags") -> DataFrame:
    """Flag arrivals against bars per product (stream-static join).

    ``thresholds`` must be a stored table: a lazy frame would be computed anew, and might move, with every batch.
    """
    flagged = silent_killers.flag_silent_killers(stream, thresholds, by=["product_id"])
    return to_table(
        flagged.select("review_id", "product_id", "star_rating", "prob_negative", "is_silent_killer"), name
    )


def dedup_stream(stream: DataFrame, watermark: str = "1 day", name: str = "dedup") -> DataFrame:
    """Drop re-deliveries of a review that arrive within the watermark of the first."""
    unique = stream.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["review_id"])
    return to_table(unique, name)
