"""The exact search off the driver and the inverted lists, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietstar.operators import search, vector_index


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty tight bundles of directions, one of them with a third of all rows."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 24))
    own = np.where(draw.random(3000) < 1 / 3, 0, draw.integers(0, 40, 3000))
    vectors = centres[own] + draw.normal(scale=0.25, size=(3000, 24))
    return vectors, frame(spark, vectors).repartition(6).cache()


def asked(df, every=20):
    return df.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def neighbours(vectors, at, k):
    x = vectors.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x[at], 9)
    return np.lexsort((np.arange(len(x)), -sims))[:k].tolist()


def test_lists_find_most_neighbours_in_few_rows(spark, clustered, monkeypatch):
    monkeypatch.setattr(vector_index, "PIECE", 100)
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    _, df = clustered
    index = vector_index.build_index(df)
    assert index.sizes.agg(F.sum("n")).first()[0] == 3000
    got = vector_index.search_recall(index, df, asked(df)).first()
    assert got["n_queries"] == 150 and got["recall"] >= 0.9 and got["share_scanned"] < 0.4
    assert index.lists.groupBy("list", "piece").count().agg(F.max("count")).first()[0] < 200


def test_all_probes_are_the_exact_search(spark, clustered, monkeypatch):
    monkeypatch.setattr(vector_index, "PIECE", 64)
    monkeypatch.setattr(vector_index, "BLOCK", 8)
    vectors, df = clustered
    index = vector_index.build_index(df, lists=7)
    got = vector_index.search_index(index, asked(df, 300), 5, probes=len(index.centroids))
    found = {}
    for r in got.orderBy("query_id", "rank_no").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["n_scanned"] == 3000
    assert found == {q: neighbours(vectors, q, 5) for q in range(0, 3000, 300)}


def test_more_probes_never_find_less(spark, clustered):
    _, df = clustered
    index = vector_index.build_index(df, lists=20)
    recalls = [vector_index.search_recall(index, df, asked(df, 50), probes=p).first()["recall"] for p in (1, 4, len(index.centroids))]
    assert recalls == sorted(recalls) and recalls[-1] == 1


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, q array<float>")
    exact = [(r["vec_id"], r["similarity"]) for r in search.semantic_search(df, q, 3).orderBy("rank_no").collect()]
    assert exact == [(1, 1.0), (4, 1.0), (2, 0.0)]
    index = vector_index.build_index(df, lists=2)
    assert vector_index.search_index(index, q, 1, probes=2).first()["vec_id"] == 1
    none = vector_index.build_index(df.limit(0))
    assert vector_index.search_index(none, q, 3).count() == 0


def test_exact_search_reads_the_index_once(spark, clustered, monkeypatch):
    vectors, df = clustered
    monkeypatch.setattr(search, "BLOCK", 10)
    monkeypatch.setattr(search, "CHUNK", 128)
    got = search.semantic_search(df, asked(df, 60), 4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("InMemoryRelation") == 2  # the index and the packed queries
    found = {}
    for r in got.orderBy("query_id", "rank_no").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {q: neighbours(vectors, q, 4) for q in range(0, 3000, 60)}


def test_best_rows_break_ties_by_name():
    sims = np.array([[0.5, 0.9, 0.9, 0.5, 0.9], [0, 0, 0, 0, 0]])
    names = np.array([5, 4, 3, 2, 1])
    assert names[search.best_rows(sims, names, 4)].tolist() == [[1, 3, 4, 2], [1, 2, 3, 4]]
    assert search.best_rows(sims, names, 9).shape == (2, 5) and search.best_rows(np.zeros((2, 0)), names[:0], 3).shape == (2, 0)
