"""Stage tables, nested documents and dimension updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_stage(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Write one stage table.

    Partition columns should have few values (a month, a segment). The rows are not gathered per
    partition value first, so a value that holds a third of them is still written by many tasks.
    """
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def as_json(df: DataFrame, key: str = "product_id", alias: str = "document") -> DataFrame:
    """One JSON text per row, keyed."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias(alias))


def records(columns: Sequence[Column], order_by: int = 1) -> Column:
    """Sorted array of structs; only for groups of bounded size, such as the aspects of a product."""
    return F.sort_array(F.collect_list(F.struct(*columns)))


def patch_products(products: DataFrame, identity: DataFrame, key: str = "product_id") -> DataFrame:
    """Resolved brand always, resolved title only when there is one."""
    fix = identity.select(
        key, F.col("brand").alias("_brand"), F.nullif(F.col("title"), F.lit("")).alias("_title")
    )
    return (
        products.join(fix, key, "left")
        .withColumn("brand", F.coalesce("_brand", "brand"))
        .withColumn("title", F.coalesce("_title", "title"))
        .drop("_brand", "_title")
    )
