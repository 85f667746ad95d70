"""Texts are split to count their terms and to write them, and not again."""

from pyspark.sql import functions as F

from quietstar.operators import aspects


def test_topics_split_each_text_twice(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(text):
        read.add(1)
        return text

    texts = [(i, " ".join(f"{'ab'[i % 2]}{(i + j) % 5}" for j in range(8))) for i in range(40)]
    df = spark.createDataFrame(texts, "review_id long, body string").coalesce(1)
    df = df.withColumn("clean_text", passed.asNondeterministic()("body"))
    model, found = aspects.fit_topics(df, k=2, min_size=3)
    got = {r["review_id"]: r["topic_id"] for r in found.collect()}
    assert len({got[i] for i in range(0, 40, 2)}) == len({got[i] for i in range(1, 40, 2)}) == 1 and len(set(got.values())) == 2
    assert read.value <= 2 * 40 and found.columns == [*df.columns, "topic_id"]
    again = model.transform(df).select("review_id", "_cluster").collect()
    assert {r[0]: r[1] for r in again} == got
