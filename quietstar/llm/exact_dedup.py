"""Exact de-duplication: rows are grouped by a 128-bit content hash and compared byte by byte inside a group.

Grouping by (hash, text) compares the bytes wherever hashes agree, and combines copies on the map side, so a group with a
third of all rows reaches a reducer as one row per task. The texts cross the network once. Groups of one row are dropped
before the way back, which joins on digests only and leaves a hot group to the skew join.

Defined results: a null text is empty and equals other empty texts; rows without an id never stay before rows with one; rows
repeated with the same id and text have the same result in :func:`exact_copies` and are one row in :func:`drop_copies`; an
empty table gives an empty result; other columns are carried and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import read_back
from . import common as C

#: Marked rows (24 bytes each) up to here are broadcast, more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
WHITESPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def hash128(body: Column) -> Column:
    return F.unhex(F.md5(body))


def copy_groups(docs: DataFrame, id_col: str, text_col: str, content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per text that occurs more than once: ``h``, ``s`` (its digests), ``keep`` (smallest id), ``n`` (rows)."""
    body = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    keyed = body.select("id", "body", content_hash(F.col("body")).alias("h"))
    exact = keyed.groupBy("h", "body").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    digests = exact.select("h", F.unhex(F.sha2("body", 256)).alias("s"), "keep", "n")
    # The way back joins on both digests; two texts that share both would be mixed up, so that stops the job.
    return digests.groupBy("h", "s").agg(
        F.min("keep").alias("keep"), F.sum("n").alias("n"),
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share both digests")).cast("string")).alias("clash"),
    ).where("clash IS NULL AND n > 1").drop("clash")


def _matched(docs: DataFrame, id_col: str, text_col: str, content_hash: Callable[[Column], Column]) -> DataFrame:
    groups = read_back(docs.sparkSession, copy_groups(docs, id_col, text_col, content_hash), "copies")
    body = normalised(F.col(text_col))
    rows = C.carried(docs, F.col(id_col).alias("id"), content_hash(body).alias("h"), F.unhex(F.sha2(body, 256)).alias("s"))
    return rows.join(groups, ["h", "s"], "left")


def exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = hash128
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return _matched(docs, id_col, text_col, content_hash).select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = hash128
) -> DataFrame:
    """The documents that stay, with the columns of ``docs``. Texts stay where they are while few rows go."""
    spark = docs.sparkSession
    copies = _matched(docs.select(id_col, text_col), id_col, text_col, content_hash).where("n IS NOT NULL")
    copies = read_back(spark, copies.select("id", "h", F.expr("id <=> keep").alias("stays")), "matched")
    keyed = copies.groupBy("id", "h").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
    # Rows that go, and rows that stay but stand there several times.
    marked = read_back(spark, keyed.where("NOT stays OR rows > 1").select("id", "h", F.expr("stays").alias("again")), "marked")
    total, again = marked.agg(F.count(F.lit(1)), F.count_if("again")).first()
    sent = lambda df: F.broadcast(df) if total <= BROADCAST_ROWS else df
    rows = C.carried(docs, F.col(id_col).alias("own"), content_hash(normalised(F.col(text_col))).alias("own_h"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("own_h") == F.col("h"))
    out = rows.join(sent(marked), same, "left_anti")
    if again:
        out = out.unionByName(rows.join(sent(marked.where("again")), same, "left_semi").dropDuplicates(["own", "own_h"]))
    return C.released(out)
