"""Connected components of an edge table by alternating large and small stars.

Every node ends linked to the smallest node of its component. Both stars are group minima (combined on the map side) joined
back to the edges; minima and edges are written before each join, so a node with very many edges is split by the skew join
and a lost executor costs no recomputation of earlier rounds. Few minima are broadcast instead, and few edges written in few
tasks. The number of rounds is logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_back
from . import common as C


def _settled(edges: DataFrame, rows: int) -> bool:
    """Whether every node has one smaller neighbour at most, and those that have one are nobody's: another round changes nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("x"))
    met = ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 0 AND n > 1")
    return C.in_few_tasks(met, 2 * rows).limit(1).count() == 0


def components(spark: SparkSession, edges: DataFrame, most: int | None = None) -> DataFrame:
    """``node``, ``component`` for each node of ``edges`` (columns ``a``, ``b`` of one orderable type).

    ``component`` is the smallest node reachable, itself included. Nulls and loops in ``edges`` are no links. ``most``: about how
    many rows ``edges`` has, where that is known.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = read_back(spark, edges if most is None else C.in_few_tasks(edges, most), "edges")
    # No later table has more than two rows for each of these edges.
    rows = edges.count()
    few = lambda df: C.in_few_tasks(df, 2 * rows)
    while not _settled(edges, rows):
        # Large star: every node links its larger neighbours to the smallest node it sees.
        both = edges.union(edges.select("b", "a"))
        low = read_back(spark, few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))), "low")
        large = both.join(C.sent(low, 2 * rows), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = read_back(spark, few(large), "large")
        # Small star: every node links itself and its smaller neighbours to the smallest of them.
        low = read_back(spark, few(large.groupBy("a").agg(F.min("b").alias("m"))), "low")
        near = large.join(C.sent(low, 2 * rows), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = read_back(spark, few(near.union(low.select("a", F.col("m").alias("b"))).distinct()), "small")
        edges = small
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(few(roots))
