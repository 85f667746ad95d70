"""Aspects of a product: assignment, terms, labels, quotes, statistics and heatmaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizer, HashingTF, IDF, NGram, Normalizer, SQLTransformer, StopWordsRemover, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, maths, text
from ..session import read_back
from . import columns, ranking

Rules = Sequence[tuple[str, Sequence[str]]]


def min_words(df: DataFrame, n: int = 5, column: str = "clean_text") -> DataFrame:
    return df.filter(text.word_count(F.col(column)) >= n)


def with_clean_text(df: DataFrame, n: int = 5) -> DataFrame:
    return min_words(columns.compute_once(df, {"clean_text": text.clean_text(F.col("review_text"))}), n)


def drop_outliers(df: DataFrame) -> DataFrame:
    return df.filter(F.col("topic_id") != fixed.OUTLIER_TOPIC)


def aspect_columns(rules: Rules = fixed.ASPECT_RULES) -> dict[str, Sequence[str]]:
    return {f"_rule_{i}": words for i, (_, words) in enumerate(rules)}


def keyword_aspects(df: DataFrame, rules: Rules = fixed.ASPECT_RULES, text_col: str = "review_text") -> DataFrame:
    """The rule with most word hits, the earlier one on ties, outlier when nothing hits."""
    return aspects_from_hits(columns.lexicon_hits(df, text_col, aspect_columns(rules)), rules)


def aspects_from_hits(counted: DataFrame, rules: Rules = fixed.ASPECT_RULES) -> DataFrame:
    hits = [F.col(c) for c in aspect_columns(rules)]
    top = F.greatest(*hits) if len(hits) > 1 else hits[0]
    number = F.coalesce(*[F.when((h == top) & (h > 0), F.lit(i)) for i, h in enumerate(hits)], F.lit(fixed.OUTLIER_TOPIC))
    label = F.coalesce(
        *[F.when(F.col("topic_id") == i, F.lit(name)) for i, (name, _) in enumerate(rules)], F.lit(fixed.OUTLIER_LABEL)
    )
    return (
        counted.withColumn("topic_id", number.cast("bigint"))
        .withColumn("topic_label", label)
        .drop(*aspect_columns(rules))
    )


# ---- discovered topics ---------------------------------------------------------------------


def fit_topics(
    df: DataFrame, k: int = 5, min_size: int = 20, text_col: str = "clean_text", vocabulary: int = 1 << 15,
    seed: int = 42, iterations: int = 20,
):
    """Cluster texts on uni- and bigram TF-IDF; clusters below ``min_size`` become outliers.

    Returns the fitted model and the frame with ``topic_id``. The vocabulary is bounded, so centres
    stay small; cluster sizes are counted on Spark and joined back as a table of at most ``k`` rows.
    Texts are split twice, to count their terms and to write them as counts of the vocabulary, which all later steps read.
    """
    words = Pipeline(stages=[
        Tokenizer(inputCol=text_col, outputCol="_words"),
        StopWordsRemover(inputCol="_words", outputCol="_kept"),
        NGram(n=2, inputCol="_kept", outputCol="_bigrams"),
        SQLTransformer(statement="SELECT *, concat(_kept, _bigrams) AS _terms FROM __THIS__"),
    ]).fit(df)
    split = words.transform(df)
    counter = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=vocabulary, minDF=2.0).fit(split)
    counts = read_back(df.sparkSession, counter.transform(split).select(*df.columns, "_tf"), "term-counts")
    weigh = Pipeline(stages=[
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_features"),
        KMeans(featuresCol="_features", predictionCol="_cluster", k=k, seed=seed, maxIter=iterations),
    ]).fit(counts)
    return PipelineModel([words, counter, weigh]), assign_topics(counts, weigh, min_size).select(*df.columns, "topic_id")


def assign_topics(df: DataFrame, model, min_size: int = 20) -> DataFrame:
    assigned = model.transform(df).select(*df.columns, "_cluster")
    sizes = assigned.groupBy("_cluster").agg(F.count(F.lit(1)).alias("_size"))
    return (
        assigned.join(F.broadcast(sizes), "_cluster")  # at most k rows
        .withColumn(
            "topic_id",
            F.when(F.col("_size") >= min_size, F.col("_cluster")).otherwise(F.lit(fixed.OUTLIER_TOPIC)).cast("bigint"),
        )
        .drop("_cluster", "_size")
    )


def cluster_vectors(df: DataFrame, features: str, k: int, min_size: int = 1, seed: int = 42) -> DataFrame:
    """KMeans over an array column with the same minimum-size rule."""
    from pyspark.ml.functions import array_to_vector

    vectors = df.withColumn("_vector", array_to_vector(F.col(features).cast("array<double>")))
    model = KMeans(featuresCol="_vector", predictionCol="_cluster", k=k, seed=seed, maxIter=20).fit(vectors)
    return assign_topics(vectors, model, min_size).drop("_vector")


def cluster_purity(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Share of rows whose cluster's most frequent true label is their own."""
    cells = df.groupBy(cluster, truth).agg(F.count(F.lit(1)).alias("n"))
    return (
        cells.groupBy(cluster)
        .agg(F.max("n").alias("top"), F.sum("n").alias("size"))
        .agg((F.sum("top") / F.sum("size")).alias("purity"), F.count(F.lit(1)).alias("clusters"))
    )


def class_tfidf(
    df: DataFrame, topic_col: str = "topic_label", text_col: str = "clean_text", bigrams: bool = True,
    stop_words: Sequence[str] | None = None, damp: bool = True, by: Sequence[str] = (),
) -> DataFrame:
    """Term weights per topic: L1-normalised frequency (damped by a square root) times ln(1 + A/f).

    The texts are read and split once: counts by topic and term combine before the shuffle and are stored, and sizes, corpus
    counts and the mean size come from them. With ``by`` each such group is a corpus of its own.
    """
    stops = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else list(stop_words)
    words = F.filter(F.split(F.col(text_col), " "), lambda w: w != "")
    if stops:
        kept = F.filter(words, lambda w: ~w.isin(*stops))
    else:
        kept = words
    keys = list(by)
    base = df.select(*keys, F.col(topic_col), kept.alias("_w"))
    if bigrams:
        # Each word beside its successor; the last word has none and yields no pair.
        successor = F.slice(F.col("_w"), F.lit(2), F.greatest(F.size("_w"), F.lit(1)))
        beside = base.select(*keys, topic_col, F.explode(F.arrays_zip(F.col("_w").alias("a"), successor.alias("b"))).alias("p"))
        pair = F.concat("p.a", F.lit(" "), "p.b")
        terms = beside.select(*keys, topic_col, F.explode(F.array("p.a", pair)).alias("term")).filter("term IS NOT NULL")
    else:
        terms = base.select(*keys, topic_col, F.explode("_w").alias("term"))
    tf = read_back(df.sparkSession, terms.groupBy(*keys, topic_col, "term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    sizes = tf.groupBy(*keys, topic_col).agg(F.sum("tf").alias("_size"))
    corpus = tf.groupBy(*keys, "term").agg(F.sum("tf").alias("_f"))
    if keys:
        sizes = sizes.withColumn("_average", F.avg("_size").over(W.partitionBy(*keys)))
        average = F.col("_average")
    else:
        average = ranking.one_value(sizes.agg(F.avg("_size").alias("a")), "a")
        # A row for each topic: joined by shuffle, all terms of a topic would meet in one task.
        sizes = F.broadcast(sizes)
    share = F.col("tf") / F.col("_size")
    weight = (F.sqrt(share) if damp else share) * F.log(1 + average / F.col("_f"))
    return tf.join(sizes, [*keys, topic_col]).join(corpus, [*keys, "term"]).select(*keys, topic_col, "term", "tf", weight.alias("weight"))


def top_terms(weights: DataFrame, k: int = 10, topic_col: str = "topic_label", by: Sequence[str] = ()) -> DataFrame:
    return ranking.top_per_group(weights, [*by, topic_col], [F.desc(F.round("weight", 9)), F.asc("term")], k)


def label_topics(
    terms: DataFrame, rules: Rules = fixed.ASPECT_RULES, overrides: Mapping[str, str] = fixed.ASPECT_OVERRIDES, by: Sequence[str] = (),
) -> DataFrame:
    """Name each topic (of each group of ``by``) after the rule that shares most of its top terms.

    ``terms``: topic_id, term, rank_no. The first best rule wins; without any overlap the name is
    "Aspect N+1", then ``overrides`` applies. A topic has at most ten top terms.
    """
    words = terms.filter("rank_no <= 10").groupBy(*by, "topic_id").agg(F.collect_set("term").alias("_terms"))
    overlaps = [
        F.size(F.array_intersect(F.col("_terms"), F.array(*[F.lit(w) for w in synonyms]))) for _, synonyms in rules
    ]
    top = F.greatest(*overlaps) if len(overlaps) > 1 else overlaps[0]
    named = F.coalesce(*[F.when((o == top) & (o > 0), F.lit(name)) for o, (name, _) in zip(overlaps, rules)])
    automatic = F.coalesce(named, F.concat(F.lit("Aspect "), (F.col("topic_id") + 1).cast("string")))
    override = F.coalesce(*[F.when(F.col("_auto") == k, F.lit(v)) for k, v in overrides.items()], F.col("_auto")) \
        if overrides else F.col("_auto")
    return (
        words.withColumn("_auto", automatic)
        .withColumn("topic_label", F.when(F.col("topic_id") == fixed.OUTLIER_TOPIC, fixed.OUTLIER_LABEL).otherwise(override))
        .select(*by, "topic_id", "topic_label", top.cast("bigint").alias("overlap"))
    )


def representative_quotes(
    df: DataFrame, k: int = 3, by: Sequence[str] = ("product_id", "topic_label"), text_col: str = "clean_text", dims: int = 256
) -> DataFrame:
    """The ``k`` texts nearest their group's centroid, ranked.

    Texts become hashed unit vectors of fixed width; the centroid is a mergeable mean, so a group of
    any size costs one vector per task. Only vectors are joined back, and the text of the winners.
    """
    vectors = Pipeline(stages=[
        Tokenizer(inputCol=text_col, outputCol="_words"),
        StopWordsRemover(inputCol="_words", outputCol="_kept"),
        HashingTF(inputCol="_kept", outputCol="_tf", numFeatures=dims),
        Normalizer(inputCol="_tf", outputCol="_unit"),
    ])
    unit = vectors.fit(df).transform(df)
    centres = unit.groupBy(*by).agg(vector_to_array(Summarizer.mean(F.col("_unit"))).alias("_centre"))
    scored = unit.join(centres, list(by)).withColumn(
        "centrality", F.round(maths.cosine(vector_to_array("_unit"), F.col("_centre")), 9)
    )
    order = [F.desc("centrality"), F.asc("review_id")]
    return ranking.top_per_group(
        scored.select(*by, "review_id", "centrality", F.col("review_text").alias("quote_text")), by, order, k, "quote_rank",
        spread_by=F.col("review_id"),
    )


def project_2d(df: DataFrame, text_col: str = "clean_text", vocabulary: int = 500) -> DataFrame:
    """Two truncated-SVD coordinates of each text's TF-IDF row, for a cluster map.

    The right singular vectors come from the ``vocabulary``-square Gram matrix, which Spark sums over
    all rows; rows are then projected where they lie.
    """
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    counted = Pipeline(stages=[
        Tokenizer(inputCol=text_col, outputCol="_words"),
        StopWordsRemover(inputCol="_words", outputCol="_kept"),
        CountVectorizer(inputCol="_kept", outputCol="_tf", vocabSize=vocabulary),
    ]).fit(df)
    counts = read_back(df.sparkSession, counted.transform(df).select("_tf"), "term-counts")
    weigh = Pipeline(stages=[IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="_row")]).fit(counts)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(weigh.transform(counts).select("_row"), "_row"))
    # The root of the Gram matrix has its singular vectors and as many rows as terms; no step of their search reads the texts.
    values, vectors = np.linalg.eigh(matrix.computeGramianMatrix().toArray())
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    axes = RowMatrix(df.sparkSession.sparkContext.parallelize(root.tolist(), 1)).computeSVD(2).V.toArray()
    rows = weigh.transform(counted.transform(df)).select(*df.columns, "_row")
    dense = F.col("_dense")
    out = rows.withColumn("_dense", vector_to_array("_row"))
    for i, name in enumerate(("x", "y")):
        axis = F.array(*[F.lit(float(v)) for v in axes[:, i]])
        out = out.withColumn(name, maths.dot(dense, axis))
    return out.drop("_row", "_dense")


# ---- statistics ----------------------------------------------------------------------------


def aspect_stats(df: DataFrame, by: Sequence[str] = ("product_id",)) -> DataFrame:
    """Volume, mean emotions and score per aspect; shares are taken after the aggregation."""
    stats = df.groupBy(*by, "topic_label").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg("emo_anger").alias("mean_anger"),
        F.avg("emo_sadness").alias("mean_disapp"),
        F.avg("emo_joy").alias("mean_joy"),
        F.avg("sentiment_score").alias("mean_sentiment"),
    )
    per_product = W.partitionBy(*by)
    return stats.withColumn(
        "frequency_pct", F.col("review_count") / F.sum("review_count").over(per_product) * 100
    ).withColumn("emotional_intensity", F.col("mean_anger") + F.col("mean_disapp"))


def emotion_heatmap(df: DataFrame, by: Sequence[str] = ("product_id",)) -> DataFrame:
    """Aspect by dominant emotion, each row in percent, columns in fixed order."""
    names = [fixed.EMOTION_DISPLAY[e] for e in fixed.ACTIVE_EMOTIONS]
    counts = df.groupBy(*by, "topic_label").pivot("dominant_emotion_display", names).count().na.fill(0)
    total = sum((F.col(c) for c in names), F.lit(0))
    return counts.select(*by, "topic_label", *[(F.col(c) / total * 100).alias(c.lower()) for c in names])


def urgency_heatmap(df: DataFrame, by: Sequence[str] = ("product_id",)) -> DataFrame:
    """Mean anger and disappointment in percent (and joy), with the angriest aspect marked."""
    means = df.groupBy(*by, "topic_label").agg(
        (F.avg("emo_anger") * 100).alias("anger"),
        (F.avg("emo_sadness") * 100).alias("disappointment"),
        (F.avg("emo_joy") * 100).alias("joy"),
    )
    order = W.partitionBy(*by).orderBy(F.desc(F.round("anger", 9)), F.asc("topic_label"))
    return means.withColumn("is_worst", F.row_number().over(order) == 1)
