"""Similarity search over the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths, text
from ..operators import aspects, search, vector_index
from ..sources import adapters as A
from .common import labelled_stage, rounded
from .sql import query, rnd


def _centroids(spark, sf):
    """One query vector per label: the mean of its vectors, dimension by dimension."""
    e = A.table(spark, sf, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return dims.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q")).select(
        F.col("label").cast("bigint").alias("query_id"), "q"
    )


def _search(spark, sf):
    return search.semantic_search(A.table(spark, sf, "embeddings"), _centroids(spark, sf), 6)


def _similarity(spark, sf):
    e = A.table(spark, sf, "embeddings").withColumn("query_id", F.col("label").cast("bigint"))
    return rounded(e.join(_centroids(spark, sf), "query_id").select("vec_id", maths.cosine(F.col("embedding"), F.col("q")).alias("similarity")))


def _insight(spark, sf):
    matches = _search(spark, sf).withColumnRenamed("vec_id", "review_id").join(labelled_stage(spark, sf), "review_id")
    return rounded(search.match_insight(matches))


def _index(spark, sf):
    rows = aspects.with_clean_text(A.reviews(spark, sf)).select("review_id", "clean_text")
    return search.embed(rows, search.fit_embedder(rows)).select("review_id", "embedding")


def _text_search(spark, sf):
    """Every benchmark item as a typed question against the review index."""
    rows = aspects.with_clean_text(A.reviews(spark, sf)).select("review_id", "clean_text")
    asked = A.table(spark, sf, "benchmark").select("item_id", text.clean_text(F.col("text")).alias("clean_text"))
    model = search.fit_embedder(rows)
    questions = search.embed(asked, model).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.semantic_search(search.embed(rows, model), questions, 3, key="review_id")


def _index_search(spark, sf):
    """The searches of ``semantic_search`` over inverted lists."""
    index = vector_index.build_index(A.table(spark, sf, "embeddings"))
    return rounded(vector_index.search_index(index, _centroids(spark, sf), 6))


def _recall(spark, sf):
    """What the inverted lists find of the exact neighbours of every twentieth vector, and the share of rows they read for it."""
    vectors = A.table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return rounded(vector_index.search_recall(vector_index.build_index(vectors), vectors, asked))


QUERIES = {
    "cosine_similarity": _similarity,
    "semantic_search": lambda s, d: rounded(_search(s, d)),
    "semantic_search_lsh": _index_search,
    "search_recall": _recall,
    "copilot_insight": _insight,
    "embedding_index": _index,
    "text_search": _text_search,
}

_SEARCH = {
    "dims": "SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings",
    "centroids": """
        SELECT label::bigint AS query_id, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS m FROM dims GROUP BY ALL) GROUP BY ALL""",
    "found": """
        SELECT query_id, vec_id, round(list_cosine_similarity(embedding::double[], q), 9) AS similarity
        FROM embeddings, centroids""",
    "best": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank_no FROM found QUALIFY rank_no <= 6",
    "joined": "SELECT * FROM best JOIN labelled ON vec_id = review_id",
    "matched": """
        SELECT query_id, count(*) AS n_matches, avg(sentiment_score) AS s, avg(star_rating) AS r, avg(is_silent_killer::int) * 100 AS k FROM joined GROUP BY ALL""",
    "modal": """
        SELECT query_id, topic_label AS top_aspect FROM (SELECT query_id, topic_label, count(*) AS c FROM joined GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, topic_label) = 1""",
}

ORACLES = {
    "cosine_similarity": query(f"""
        SELECT vec_id, {rnd("list_cosine_similarity(embedding::double[], q)", "similarity")}
        FROM embeddings JOIN centroids ON label = query_id""", **_SEARCH),
    "semantic_search": query(f"SELECT query_id, vec_id, {rnd('similarity', 'similarity')}, rank_no FROM best", **_SEARCH),
    "copilot_insight": query(f"""
        SELECT query_id, n_matches, {rnd("s", "avg_sentiment")}, {rnd("r", "avg_star")}, {rnd("k", "sk_rate")}, top_aspect, tone,
          'Matches: mean sentiment ' || printf('%+.2f', round(s, 2) + 0) || ' (' || tone || '), mean stars '
            || printf('%.1f', round(r, 1)) || ', main aspect ' || top_aspect
            || CASE WHEN round(k) > 0 THEN ', silent killers ' || printf('%.0f', round(k)) || '%' ELSE '' END AS insight
        FROM (SELECT *, CASE WHEN s < -0.1 THEN 'negative' WHEN s > 0.1 THEN 'positive' ELSE 'mixed/neutral' END AS tone FROM matched)
        JOIN modal USING (query_id)""", **_SEARCH),
}
