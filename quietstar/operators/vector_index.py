"""A vector index as tables: coarse centroids, and inverted lists cut into pieces of bounded size.

Every vector stands in the list of its nearest centroid. A query probes the lists of its nearest centroids only, so a search reads
a share of the rows; how many lists give the wanted recall is measured against the exact search on drawn rows of the index.
Centroids are fitted on a bounded sample, but every row is indexed.

Pieces and query blocks meet by a shuffle join on (list, piece, block): a long list is many pieces and a list that many queries
probe is copied for each block of them, so no task gets more than ``PIECE`` rows and about ``BLOCK`` queries at once. Centroids and
list sizes, at most ``MAX_LISTS`` rows, are what is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import read_back
from . import ranking, search

PIECE = 4096
BLOCK = 1024
MAX_LISTS = 4096
#: Similarities to centroids that a task holds at once.
SIMILARITIES = 1 << 20
#: Vectors that centroids are fitted on, and rows that probes are measured on.
FIT_ROWS = 20_000
TRIED_ROWS = 200


@dataclass
class VectorIndex:
    """``lists``: list, piece, key and unit vector of every row. ``sizes``: rows and pieces of each list."""

    lists: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    key: str
    probes: int

    @property
    def rows(self) -> Column:
        return ranking.one_value(self.sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "n")


def _drawn(df: DataFrame, key: str, rows: int, total: int, salt: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, by a hash of the key."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1_000_000)) < math.ceil(min(1.0, rows / max(total, 1)) * 1_000_000))


def fit_centroids(df: DataFrame, key: str, vector: str, lists: int, total: int, seed: int = 42) -> np.ndarray:
    """Unit centroids of about ``FIT_ROWS`` drawn vectors."""
    # Null vectors and those of length nought have no direction; they are indexed, but not learned from.
    sample = _drawn(df.where(F.exists(vector, lambda x: x != 0)), key, FIT_ROWS, total, 1)
    points = sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
    if points.isEmpty():
        return np.zeros((0, 0))
    model = KMeans(featuresCol="x", k=max(lists, 2), seed=seed, maxIter=15, distanceMeasure="cosine").fit(points)
    found = np.array(model.clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of lists."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.ravel()).cast(kind))


def _nearest(centroids: np.ndarray, probes: int):
    """Adds ``probed``: the ``probes`` nearest lists of each vector, nearest first.

    Vectors are compared in parts of a batch, so that what is held does not grow with the number of lists.
    """
    step = max(1, SIMILARITIES // max(1, len(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = search.unit_matrix(batch.column("vector"))
            for at in range(0, len(every), step):
                x = every[at : at + step]
                if not len(centroids) or not x.shape[1]:
                    order = np.zeros((len(x), 1), np.int64)
                elif probes == 1:
                    order = np.argmax(x @ centroids.T, axis=1)[:, None]
                else:
                    order = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]
                cols = {"key": batch.column("key").slice(at, len(x)), "vector": _lists(x, pa.float64()), "probed": _lists(order, pa.int32())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def probed(df: DataFrame, key: str, vector: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """``key``, unit ``vector`` and its ``probes`` nearest lists."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("probed", T.ArrayType(T.IntegerType())),
    ])
    return rows.mapInArrow(_nearest(centroids, probes), schema)


def build_index(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, k: int = 6, recall: float = 0.95, seed: int = 42
) -> VectorIndex:
    """The index of all rows, with ``probes`` such that the share of true neighbours found on drawn rows is at least ``recall``.

    ``lists`` is about the root of the number of rows unless it is given.
    """
    spark = df.sparkSession
    total = df.count()
    wanted = min(MAX_LISTS, lists or max(1, round(math.sqrt(total))))
    centroids = fit_centroids(df, key, vector, wanted, total, seed)
    placed = probed(df, key, vector, centroids, 1).select(F.col("probed")[0].alias("list"), "key", "vector")
    placed = read_back(spark, placed, "assigned")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int"))
    sizes = read_back(spark, sizes, "list-sizes")
    piece = F.pmod(F.xxhash64("key"), F.col("pieces").cast("long")).cast("int")
    cut = placed.join(F.broadcast(sizes), "list").select("list", piece.alias("piece"), "key", "vector")
    cut = read_back(spark, cut.repartition("list", "piece").sortWithinPartitions("list", "piece"), "lists")
    index = VectorIndex(cut, sizes, centroids, key, max(1, len(centroids)))
    index.probes = probes_for(index, k, recall)
    return index


def probes_for(index: VectorIndex, k: int, recall: float) -> int:
    """The least number of probed lists that hold ``recall`` of the exact ``k`` neighbours of about ``TRIED_ROWS`` drawn rows."""
    if len(index.centroids) <= 1:
        return 1
    total = index.sizes.agg(F.sum("n")).first()[0] or 0
    tried = _drawn(index.lists, "key", TRIED_ROWS, total, 2).select(F.col("key").alias("query_id"), F.col("vector").alias("q"))
    near = search.semantic_search(index.lists, tried, k, "vector", "key").select("query_id", "key")
    near = near.join(index.lists.select("key", "list"), "key")
    order = probed(tried, "query_id", "q", index.centroids, len(index.centroids)).select(F.col("key").alias("query_id"), "probed")
    places = near.join(order, "query_id").select(F.array_position("probed", F.col("list")).alias("place"))
    counts = {r["place"]: r["count"] for r in places.groupBy("place").count().collect()}
    found, all_found = 0, sum(counts.values())
    for probes in range(1, len(index.centroids) + 1):
        found += counts.get(probes, 0)
        if found >= recall * all_found:
            return probes
    return len(index.centroids)


def _meet(k: int, schema: T.StructType):
    names = schema.fieldNames()

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        # A side may be empty: a piece that no query probes, or a hash that leaves a piece without rows.
        q, x = search.unit_matrix(asked.column("q")), search.unit_matrix(rows.column("vector"))
        sims = np.round(q @ x.T, 9) if len(q) and len(x) else np.zeros((len(q), 0))
        keys = rows.column("key")
        found = search.best_rows(sims, keys.to_numpy(), k)
        at = pa.array(np.repeat(np.arange(len(q)), found.shape[1]))
        best = np.take_along_axis(sims, found, 1).ravel()
        return pa.table({names[0]: asked.column("query_id").take(at), names[1]: keys.take(pa.array(found.ravel())), names[2]: pa.array(best)})

    return run


def search_index(index: VectorIndex, queries: DataFrame, k: int = 6, probes: int | None = None) -> DataFrame:
    """The ``k`` most similar rows per query (``query_id``, ``q``) of the lists it probes, with the rows that were compared.

    Columns: query_id, the index's key, ``similarity``, ``rank_no``, ``n_scanned``. With as many ``probes`` as lists the search is exact.
    """
    spark = queries.sparkSession
    asked = probed(queries, "query_id", "q", index.centroids, probes or index.probes)
    asked = asked.select(F.col("key").alias("query_id"), F.col("vector").alias("q"), F.explode("probed").alias("list"))
    asked = read_back(spark, asked, "probes")
    blocks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    lists = read_back(spark, index.sizes.join(blocks, "list"), "probed-lists")
    scanned = asked.join(F.broadcast(lists.select("list", "n")), "list").groupBy("query_id").agg(F.sum("n").alias("n_scanned"))
    spread = F.pmod(F.xxhash64("query_id", F.lit(3)), F.col("blocks").cast("long")).cast("int")
    sides = ["list", "piece", "block"]
    asked = asked.join(F.broadcast(lists), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), spread.alias("block"), "query_id", "q")
    rows = index.lists.join(F.broadcast(lists.select("list", "blocks")), "list")
    rows = rows.select("list", "piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "vector")
    schema = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("key", rows.schema["key"].dataType), T.StructField("similarity", T.DoubleType()),
    ])
    found = asked.groupBy(*sides).cogroup(rows.groupBy(*sides)).applyInArrow(_meet(k, schema), schema)
    best = ranking.top_per_group(found, ["query_id"], [F.desc("similarity"), F.asc("key")], k)
    return best.join(scanned, "query_id").select("query_id", F.col("key").alias(index.key), "similarity", "rank_no", "n_scanned")


def search_recall(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int = 6, vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """One row: ``n_queries``, ``recall`` of the probed against the exact search, ``share_scanned``, ``n_lists``, ``probes``."""
    spark = queries.sparkSession
    exact = search.semantic_search(vectors, queries, k, vector, index.key).select("query_id", index.key, F.lit(1).alias("hit"))
    near = read_back(spark, search_index(index, queries, k, probes), "near")
    counted = exact.join(near.select("query_id", index.key, F.lit(1).alias("found")), ["query_id", index.key], "left")
    recall = counted.agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
    scanned = near.select("query_id", "n_scanned").distinct().agg(F.count(F.lit(1)).alias("n_queries"), F.avg("n_scanned").alias("scanned"))
    return scanned.select(
        "n_queries", ranking.one_value(recall, "recall").alias("recall"), F.try_divide("scanned", index.rows).alias("share_scanned"),
        F.lit(len(index.centroids)).alias("n_lists"), F.lit(probes or index.probes).alias("probes"),
    )
