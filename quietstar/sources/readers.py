"""Scans and the adapters that bring drifting headers to one schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import dates, fixed, labels
from ..session import read_back
from . import schemas


def read_reviews(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    max_scan: int | None = None,
) -> DataFrame:
    """Scan a review table, with an optional bound on the rows read."""
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.limit(max_scan) if max_scan is not None else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV at the ingest edge: no inference pass, quoted newlines kept."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_summary(spark: SparkSession, path: str, schema: T.StructType = schemas.SUMMARY) -> DataFrame:
    """Exported summary documents with the defaults a report needs for absent keys."""
    df = spark.read.schema(schema).json(path)
    return df.select(
        F.coalesce("product_id", F.lit("Unknown")).alias("product_id"),
        F.coalesce("total_reviews", F.lit(0)).cast("bigint").alias("total_reviews"),
        F.coalesce("financials.silent_killers", F.lit(0)).cast("bigint").alias("silent_killers"),
        F.coalesce("financials.revenue_at_risk_usd", F.lit(0.0)).alias("revenue_at_risk_usd"),
        F.coalesce("roi_simulation.target_aspect", F.lit("")).alias("target_aspect"),
        F.coalesce("roi_simulation.improvement_pct_high", F.lit(0.0)).alias("improvement_pct_high"),
        F.coalesce("roi_simulation.slide_pitch", F.lit("")).alias("slide_pitch"),
        F.coalesce("priority_matrix", F.array()).alias("priority_matrix"),
        F.coalesce("strategic_roadmap", F.array()).alias("strategic_roadmap"),
    )


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail when the plan is made, not when it runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def normalize_reviews(df: DataFrame, aliases: Mapping[str, Sequence[str]] = fixed.COLUMN_ALIASES) -> DataFrame:
    """Rename every known header variant to its standard name; other columns stay."""
    out = df
    for target, names in aliases.items():
        present = [n for n in names if n in out.columns]
        if not present:
            continue
        if present == [target]:
            continue
        merged = F.coalesce(*[F.col(n) for n in present])
        out = out.withColumn(target, merged).drop(*[n for n in present if n != target])
    return out


def with_defaults(df: DataFrame, defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """Add absent columns and repair present ones that do not parse.

    ``helpful_votes`` becomes a count (0 when unreadable) and ``verified_purchase`` a boolean (false
    when unreadable, so the text "False" stays false).
    """
    defaults = {"helpful_votes": 0, "verified_purchase": False} if defaults is None else defaults
    out = df
    for name, value in defaults.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
        elif isinstance(value, bool):
            out = out.withColumn(name, F.coalesce(F.col(name).cast("string").try_cast("boolean"), F.lit(value)))
        elif isinstance(value, int):
            number = F.col(name).cast("string").try_cast("double")
            out = out.withColumn(name, F.coalesce(number.cast("bigint"), F.lit(value).cast("bigint")))
        else:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def drop_invalid(df: DataFrame, columns: Sequence[str] = ("review_date", "review_text")) -> DataFrame:
    return df.na.drop(subset=list(columns))


def parse_review_time(df: DataFrame, column: str = "unix_time") -> DataFrame:
    """``review_date`` from epoch milliseconds, epoch seconds or a date text."""
    return df.withColumn("review_date", F.to_date(dates.epoch_to_timestamp(F.col(column))))


def assign_review_ids(
    df: DataFrame, columns: Sequence[str] = ("product_id", "user_id", "unix_time", "review_text"), id_col: str = "review_id",
) -> DataFrame:
    """Ids for dumps that have none: MD5 of ``columns`` (those present), repeats numbered "-2", "-3" and so on.

    Repeats are counted per input partition, partitions get offsets, and rows are numbered inside their own
    partition, so a row that a third of the table repeats is never ordered in one task. Only places are
    shuffled, and only those of repeats. An existing ``id_col`` is replaced.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in df.columns]
    marked = df.drop(id_col).withColumns({"_digest": F.md5(F.concat_ws("\u001f", *parts)), "_row": F.monotonically_increasing_id()})
    # Stored, because row places must not change between the reads below.
    rows = read_back(df.sparkSession, marked, "numbered")
    places = rows.select("_digest", "_row", F.shiftright("_row", 33).alias("_part"))
    counted = places.groupBy("_digest", "_part").agg(F.count(F.lit(1)).alias("_m"))
    earlier = W.partitionBy("_digest").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.select(
        "_digest", "_part", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_m").over(W.partitionBy("_digest")).alias("_all"),
    ).filter("_all > 1")
    inside = W.partitionBy("_digest", "_part").orderBy("_row")
    repeats = places.join(offsets, ["_digest", "_part"]).select(
        "_row", (F.col("_before") + F.row_number().over(inside)).alias("_occurrence")
    ).filter("_occurrence > 1")
    suffix = F.when(F.col("_occurrence").isNotNull(), F.concat(F.lit("-"), F.col("_occurrence").cast("string"))).otherwise("")
    return rows.join(repeats, "_row", "left").withColumn(id_col, F.concat("_digest", suffix)).drop("_digest", "_row", "_occurrence")


def lookup_metadata(meta: DataFrame, wanted_ids: DataFrame) -> DataFrame:
    """Dimension rows of the wanted products; the first record wins.

    ``meta``: product_id, title, brand, categories, main_category, record_no. The semi-join filters
    before the rank, so only matching records are shuffled.
    """
    first = W.partitionBy("product_id").orderBy("record_no")
    return (
        meta.join(wanted_ids.select("product_id"), "product_id", "left_semi")
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .select(
            "product_id",
            F.coalesce("title", F.lit("")).alias("title"),
            F.coalesce(F.nullif("brand", F.lit("")), F.lit("Unknown")).alias("brand"),
            labels.leaf_category(F.col("categories"), F.col("main_category")).alias("category"),
        )
    )


def enrich(df: DataFrame, dimension: DataFrame, key: str = "product_id", defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """Left join of a dimension with defaults for misses; Spark picks the strategy from its size."""
    out = df.join(dimension, key, "left")
    return out.fillna(dict(defaults)) if defaults else out
