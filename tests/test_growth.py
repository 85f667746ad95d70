"""Work that must not grow with the number of rounds, lists or shared keys: counted by accumulators and read from schemas and plans."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quietstar.operators import aspects, clusters, identity, languages, search, summaries, vector_index


def test_list_columns_become_the_same_unit_rows():
    for rows in ([[3.0, 4.0], [0.0, 0.0], [1.0, 0.0]], [[1.0, 2.0], None, [2.0, 1.0]], [[1.0], [1.0, 2.0]], [], [[]]):
        column = pa.chunked_array([pa.array(rows[:1], pa.list_(pa.float64())), pa.array(rows[1:], pa.list_(pa.float64()))])
        assert np.array_equal(search.unit_matrix(column), search.unit_rows(rows))
        assert np.array_equal(search.unit_matrix(pa.array([[9.0], *rows], pa.list_(pa.float64())).slice(1)), search.unit_rows(rows))


def test_a_round_sums_each_row_once(spark, monkeypatch):
    draw, summed, real = np.random.default_rng(4), spark.sparkContext.accumulator(0), clusters._sums
    rows = [(f"g{i % 3}", i, [float(x) for x in draw.normal(size=6)]) for i in range(300)]

    def counted(block, centres):
        summed.add(block.num_rows)
        return real(block, centres)

    monkeypatch.setattr(clusters, "_sums", counted)
    clusters.cluster_groups(spark.createDataFrame(rows, "product_id string, review_id long, features array<double>"), k=4, rounds=3).count()
    assert summed.value == 3 * len(rows)


def test_projection_reads_texts_a_few_times(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(text):
        read.add(1)
        return text

    draw = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{int(x)}" for x in draw.zipf(1.4, 40) % 150)) for i in range(60)]
    df = spark.createDataFrame(texts, "review_id long, body string").withColumn("clean_text", passed.asNondeterministic()("body"))
    got = aspects.project_2d(df, vocabulary=130).select("review_id", "x", "y").toPandas()
    assert len(got) == 60 and read.value <= 5 * 60
    # Coordinates of the largest spread: orthogonal, the first no smaller.
    assert abs((got.x * got.y).sum()) < 1e-6 and (got.x**2).sum() >= (got.y**2).sum() > 0


def test_vectors_are_compared_in_parts(monkeypatch):
    draw = np.random.default_rng(6)
    x, centres = draw.normal(size=(50, 4)), search.unit_rows(draw.normal(size=(8, 4)).tolist())
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(x.tolist())], ["key", "vector"])
    monkeypatch.setattr(vector_index, "SIMILARITIES", 64)
    for probes in (1, 3, 8):
        parts = list(vector_index._nearest(centres, probes)(iter([batch])))
        assert max(p.num_rows for p in parts) == 8
        found = pa.Table.from_batches(parts)
        assert found["key"].to_pylist() == list(range(50))
        assert np.array_equal(np.array(found["vector"].to_pylist()), search.unit_rows(x.tolist()))
        order = np.argsort(-(search.unit_rows(x.tolist()) @ centres.T), axis=1, kind="stable")[:, :probes]
        assert found["probed"].to_pylist() == order.tolist()


def test_texts_of_a_popular_product_stay_where_they_are(spark):
    rows = [("a", i, "Nice Senso thing with cable", "s") for i in range(30)] + [("b", 99, "A Maker hub", "s")]
    df = spark.createDataFrame(rows, "product_id string, review_id long, review_text string, review_summary string")
    products = spark.createDataFrame([("a", None, None), ("b", "Known", "Box"), ("c", "", "T")], "product_id string, brand string, title string")
    found = identity.product_identity(products, df)
    got = {r["product_id"]: (r["brand"], r["title"], r["brand_source"]) for r in found.collect()}
    assert got == {"a": ("Senso", "Cable", "review-text (best-effort)"), "b": ("Known", "Box", "metadata"), "c": ("Unknown", "T", "unresolved")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_words_of_sentences_move_with_numbers(spark, monkeypatch):
    stored, real = [], summaries.read_back
    monkeypatch.setattr(summaries, "read_back", lambda s, df, name: stored.append((name, dict(df.dtypes))) or real(s, df, name))
    rows = [("a", 1, "Bad box. Bad box. Good lid"), ("a", 2, "bad lid! Bad box"), ("b", 3, "Fine"), ("b", 4, None), ("c", 5, "...")]
    df = spark.createDataFrame(rows, "product_id string, review_id long, review_text string")
    some = {r["product_id"]: (r["summary"], r["n_complaints"]) for r in summaries.summarize(df, ["product_id"], sentences=1).collect()}
    assert dict(stored)["sentences"]["_key"] == "bigint"
    monkeypatch.setattr(summaries, "BROADCAST_ROWS", 0)
    many = {r["product_id"]: (r["summary"], r["n_complaints"]) for r in summaries.summarize(df, ["product_id"], sentences=1).collect()}
    assert some == many == {"a": ("Bad box", 2), "b": ("Fine", 2), "c": ("", 1)}


def test_words_are_counted_where_the_text_lies(spark, monkeypatch):
    monkeypatch.setattr(languages, "TEXTS", 2)
    rows = [(1, "Der der, und"), (1, "der"), (2, None), (None, "x y x"), (3, ""), (4, "12")]
    df = spark.createDataFrame(rows, "review_id long, review_text string").coalesce(1)
    found = languages.text_word_counts(df, "review_id", "review_text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.groupBy("review_id", "word").agg(F.sum("n")).collect()), key=str)
    want = sorted(map(tuple, languages.word_counts(df, ["review_id"], "review_text").collect()), key=str)
    assert got == want and (1, "der", 3) in got


def test_terms_do_not_meet_by_topic(spark):
    rows = [("t", f"w{i % 7} w{i % 5}") for i in range(40)] + [("u", "w1 w9")]
    df = spark.createDataFrame(rows, "topic_label string, clean_text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = aspects.class_tfidf(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin [topic_label" in plan
