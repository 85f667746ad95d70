"""Spherical k-means in every group of a table at once.

Centroids are a table keyed by group and cluster, so one Spark job a round moves the centroids of all groups. Rows are cut into
blocks of about ``BLOCK`` inside their group and laid out once; each round only the centroids travel to the blocks, and what comes
back is a sum for each block and cluster, combined before it is shuffled. A group with a third of all rows is many blocks.

First centroids are picked farthest-first from ``CANDIDATES`` rows of the group, drawn by a digest of the row id: the same rows
give the same clusters in any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import HashingTF, IDF, NGram, Normalizer, SQLTransformer, StopWordsRemover, Tokenizer
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, maths
from ..session import read_back
from . import ranking, search

BLOCK = 4096
CANDIDATES = 64


def text_vectors(df: DataFrame, text_col: str = "clean_text", dims: int = 512) -> DataFrame:
    """``features``: unit TF-IDF vectors of the words and word pairs of a text without stop words, hashed to a fixed width."""
    hashed = Pipeline(stages=[
        Tokenizer(inputCol=text_col, outputCol="_words"),
        StopWordsRemover(inputCol="_words", outputCol="_kept"),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dims),
    ]).fit(df)
    # Texts are split and hashed once; document frequencies and vectors both read the stored counts.
    counts = read_back(df.sparkSession, hashed.transform(df).select(*df.columns, "_tf"), "hashed-terms")
    weigh = Pipeline(stages=[IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="_unit")]).fit(counts)
    return weigh.transform(counts).select(*df.columns, vector_to_array("_unit").alias("features"))


def farthest_first(vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of ``k`` rows (or all): the first, then always the row least like those picked, the earlier on ties."""
    picked, best = [0], vectors @ vectors[0]
    while len(picked) < min(k, len(vectors)):
        best[picked] = np.inf
        picked.append(int(best.argmin()))
        best = np.maximum(best, vectors @ vectors[picked[-1]])
    return np.array(picked)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most similar centre of each row, the earlier on ties, and its similarity."""
    sims = np.round(vectors @ centres.T, 9)
    best = sims.argmax(axis=1)
    return best, sims[np.arange(len(vectors)), best]


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return search.unit_matrix(table.column(column))


def _first(k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("place")
        picked = farthest_first(_matrix(rows, "vector"), k)
        centres = rows.take(pa.array(picked))
        return pa.table({"grp": centres.column("grp"), "cluster": pa.array(np.arange(len(picked)), pa.int32()), "centre": centres.column("vector")})

    return run


def _sums(rows: pa.Table, centres: pa.Table) -> pa.Table:
    """Sum of the vectors of a block for each of its clusters."""
    if not rows.num_rows or not centres.num_rows:
        return _EMPTY_SUMS
    centres = centres.sort_by("cluster")
    x = _matrix(rows, "vector")
    own, _ = nearest(x, _matrix(centres, "centre"))
    found = np.unique(own)
    total = np.array([x[own == c].sum(axis=0) for c in found])
    group = rows.column("grp").slice(0, 1).combine_chunks()
    return pa.table({
        "grp": group.take(pa.array(np.zeros(len(found), np.int64))), "cluster": pa.array(centres.column("cluster").to_numpy()[found], pa.int32()),
        "total": pa.array(total.tolist(), pa.list_(pa.float64())),
    })


_EMPTY_SUMS = pa.table({"grp": pa.array([], pa.string()), "cluster": pa.array([], pa.int32()), "total": pa.array([], pa.list_(pa.float64()))})


def _assign(rows: pa.Table, centres: pa.Table) -> pa.Table:
    centres = centres.sort_by("cluster")
    if rows.num_rows and centres.num_rows:
        own, sims = nearest(_matrix(rows, "vector"), _matrix(centres, "centre"))
        own = centres.column("cluster").to_numpy()[own]
    else:
        own, sims = np.zeros(0, np.int32), np.zeros(0)
    return pa.table({"key": rows.column("key"), "grp": rows.column("grp"), "cluster": pa.array(own, pa.int32()), "similarity": pa.array(sims)})


def cluster_groups(
    df: DataFrame, group: str = "product_id", key: str = "review_id", vector: str = "features", k: int = 5, min_size: int = 20,
    rounds: int = 20, seed: int | str = 42,
) -> DataFrame:
    """``group``, ``key``, ``topic_id`` and ``similarity`` to the topic's centre for every row with a group and a vector.

    Topics of a group are numbered by size, the largest 0; those of fewer than ``min_size`` rows are outliers (-1). A group with
    fewer rows than ``k`` has a topic for each.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = read_back(spark, rows.where("grp IS NOT NULL AND vector IS NOT NULL"), "vectors")
    sizes = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = read_back(spark, sizes, "group-blocks")
    block = F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int")
    laid = rows.join(sizes, "grp").select("grp", block.alias("block"), "key", "vector").repartition("grp", "block")
    # Sorted before it is kept, so that no round sorts the vectors again.
    laid = laid.sortWithinPartitions("grp", "block").persist(StorageLevel.MEMORY_AND_DISK)
    place = F.md5(F.concat_ws("|", F.col("key").cast("string"), F.lit(str(seed))))
    drawn = ranking.top_per_group(rows.select("grp", place.alias("digest"), "key"), ["grp"], ["digest", "key"], CANDIDATES, "place", F.col("key"))
    drawn = drawn.join(rows, ["grp", "key"]).select("grp", "place", "vector")
    centres = drawn.groupBy("grp").applyInArrow(_first(k), "grp string, cluster int, centre array<double>")
    centres = read_back(spark, centres, "centres")
    for _ in range(rounds):
        moved = _grouped(laid, centres, sizes).applyInArrow(_sums, "grp string, cluster int, total array<double>")
        total = vector_to_array(Summarizer.sum(array_to_vector("total")))
        length = F.sqrt(maths.dot(F.col("sum"), F.col("sum")))
        unit = F.transform("sum", lambda x: F.round(F.try_divide(x, F.col("length")), 9))
        new = moved.groupBy("grp", "cluster").agg(total.alias("sum")).withColumn("length", length)
        new = new.select("grp", "cluster", F.when(F.col("length") > 0, unit).otherwise(F.col("sum")).alias("centre"))
        # Stored before it is read twice: the sums are the costly part. A cluster that lost all its rows keeps its centre.
        new = read_back(spark, new, "moved")
        kept = centres.join(new, ["grp", "cluster"], "left_anti")
        new = read_back(spark, new.unionByName(kept), "centres")
        same = new.join(centres.withColumnRenamed("centre", "old"), ["grp", "cluster"]).where("centre <> old").isEmpty()
        centres = new
        if same:
            break
    schema = T.StructType([rows.schema["key"], rows.schema["grp"], T.StructField("cluster", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
    found = read_back(spark, _grouped(laid, centres, sizes).applyInArrow(_assign, schema), "assigned")
    laid.unpersist()
    counted = found.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("n"))
    by_size = W.partitionBy("grp").orderBy(F.desc("n"), F.asc("cluster"))
    number = F.when(F.col("n") < min_size, F.lit(fixed.OUTLIER_TOPIC)).otherwise(F.row_number().over(by_size) - 1)
    topics = counted.select("grp", "cluster", number.cast("bigint").alias("topic_id"))
    return found.join(topics, ["grp", "cluster"]).select(F.col("grp").alias(group), F.col("key").alias(key), "topic_id", "similarity")


def _grouped(laid: DataFrame, centres: DataFrame, sizes: DataFrame):
    """Blocks of rows beside the centres of their group, which are copied for each block."""
    copies = centres.join(sizes, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cluster", "centre")
    return laid.groupBy("grp", "block").cogroup(copies.groupBy("grp", "block"))
