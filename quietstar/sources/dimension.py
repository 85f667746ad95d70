"""A dimension on files that is updated where it changes.

Rows lie in folders by a hash of their key. An update reads only the folders that hold a key of it, writes anew only those in which
a row really changes, and then names them in a new listing; all other files stay as they are. A listing is written as a whole or
not at all, so readers see the dimension before or after an update and never half of it, and a second writer that made the same
version fails instead of hiding the first one's work. An update that changes nothing writes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = "bucket int, folder string"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the listings that were written to their end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/listings")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    whole = [s.getPath() for s in files.listStatus(folder) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()) for p in whole)


def _folders(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """Folder of each bucket; a dimension has a fixed number of them."""
    return {r["bucket"]: r["folder"] for r in spark.read.schema(LISTING).parquet(f"{path}/listings/{version:09d}").collect()}


def _write(spark: SparkSession, path: str, version: int, rows: DataFrame, kept: dict[int, str], touched: list[int]) -> int:
    """``rows`` (with ``_bucket``) into a folder of their own, then the listing that makes them visible."""
    own = f"data/{version:09d}-{uuid.uuid4().hex}"
    rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{own}")
    listing = kept | {b: f"{own}/_bucket={b}" for b in touched}
    spark.createDataFrame(sorted(listing.items()), LISTING).coalesce(1).write.mode("errorifexists").parquet(f"{path}/listings/{version:09d}")
    return version


def create_dimension(df: DataFrame, path: str, key: str = "product_id", buckets: int = 64) -> int:
    """The first version. Rows that share a key stay rows of their own."""
    spark = df.sparkSession
    rows = df.withColumn("_bucket", _bucket(F.col(key), buckets))
    filled = [r[0] for r in rows.select("_bucket").distinct().collect()]
    marked = {-1: str(buckets)} | {b: "" for b in range(buckets) if b not in filled}
    return _write(spark, path, 1, rows, marked, filled)


def read_dimension(spark: SparkSession, path: str, schema: str | None = None, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The newest version, or another one that is still listed, as one table; ``only`` some of its buckets."""
    folders = _folders(spark, path, version or _versions(spark, path)[-1])
    paths = [f"{path}/{f}" for b, f in sorted(folders.items()) if b >= 0 and f and (only is None or b in only)]
    reader = spark.read.schema(schema) if schema else spark.read
    if paths:
        return reader.parquet(*paths)
    some = [f"{path}/{f}" for b, f in folders.items() if b >= 0 and f]
    return reader.parquet(*some).limit(0) if some else spark.createDataFrame([], schema or f"{LISTING}")


def update_dimension(
    spark: SparkSession, path: str, fix: DataFrame, patch: Callable[[DataFrame, DataFrame], DataFrame], key: str = "product_id"
) -> int:
    """``patch(rows, fix)`` on the rows whose folders hold a key of ``fix``; the number of the version that has it.

    ``patch`` returns the columns of the dimension, one row for each row it gets.
    """
    version = _versions(spark, path)[-1]
    folders = _folders(spark, path, version)
    buckets = int(folders[-1])
    asked = [r[0] for r in fix.select(_bucket(F.col(key), buckets).alias("b")).distinct().collect() if folders.get(r[0])]
    if not asked:
        return version
    rows = read_dimension(spark, path, version=version, only=asked)
    new = patch(rows, fix).select(*rows.columns)
    # Rows that the update adds or takes away, counted by bucket: equal rows cancel out.
    both = new.select(*rows.columns, F.lit(1).alias("_sign")).unionByName(rows.select("*", F.lit(-1).alias("_sign")))
    changed = both.groupBy(*rows.columns).agg(F.sum("_sign").alias("_sign")).where("_sign <> 0")
    touched = [r[0] for r in changed.select(_bucket(F.col(key), buckets).alias("b")).distinct().collect()]
    if not touched:
        return version
    rewritten = new.withColumn("_bucket", _bucket(F.col(key), buckets)).where(F.col("_bucket").isin(touched))
    return _write(spark, path, version + 1, rewritten, {b: f for b, f in folders.items() if b not in touched}, touched)
