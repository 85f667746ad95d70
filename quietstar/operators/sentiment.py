"""Sentiment, language, translation and emotion scores, and the plug-in contract for heavy models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, maths, text
from . import columns

ScorerFactory = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def score_table(df: DataFrame, factory: ScorerFactory, out_schema: T.StructType, batch_size: int = 16) -> DataFrame:
    """Run a batch scorer over every row and add its columns.

    ``factory`` is called once per task, so a model loads where it runs; the scorer gets frames of at
    most ``batch_size`` rows and returns the new columns in the same order. Filter rows and drop
    columns before this call: nothing is pushed through it.
    """
    schema = T.StructType(df.schema.fields + out_schema.fields)
    names = out_schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for frame in batches:
            if scorer is None:
                scorer = factory()
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size].reset_index(drop=True)
                scored = scorer(part).reset_index(drop=True)
                yield pd.concat([part, scored[names]], axis=1)

    return df.mapInPandas(run, schema)


# ---- sentiment ---------------------------------------------------------------------------


def _hit_columns(prefix: str, classes: Mapping[str, Sequence[str]]) -> dict[str, Sequence[str]]:
    return {f"_{prefix}_{name}": words for name, words in classes.items()}


def sentiment_columns(lexicon: Mapping[str, Sequence[str]] = fixed.SENTIMENT_LEXICON) -> dict[str, Sequence[str]]:
    return _hit_columns("sentiment", lexicon)


def emotion_columns(lexicon: Mapping[str, Sequence[str]] = fixed.EMOTION_LEXICON) -> dict[str, Sequence[str]]:
    return _hit_columns("emotion", lexicon)


def score_sentiment(
    df: DataFrame, lexicon: Mapping[str, Sequence[str]] = fixed.SENTIMENT_LEXICON, text_col: str = "review_text"
) -> DataFrame:
    """Three class probabilities and ``sentiment_score`` from lexicon hits, smoothed to sum to one."""
    return sentiment_from_hits(columns.lexicon_hits(df, text_col, sentiment_columns(lexicon)))


def sentiment_from_hits(counted: DataFrame) -> DataFrame:
    p, q = F.col("_sentiment_positive"), F.col("_sentiment_negative")
    total = p + q + 1.5
    return (
        counted.withColumn("prob_negative", (q + 0.5) / total)
        .withColumn("prob_neutral", F.lit(0.5) / total)
        .withColumn("prob_positive", (p + 0.5) / total)
        .drop("_sentiment_positive", "_sentiment_negative")
        .transform(sentiment_score)
    )


def sentiment_score(df: DataFrame) -> DataFrame:
    return df.withColumn("sentiment_score", F.col("prob_positive") - F.col("prob_negative"))


def fit_sentiment(
    df: DataFrame, text_col: str = "review_text", star_col: str = "star_rating", features: int = 1 << 14, iterations: int = 20
) -> PipelineModel:
    """Multinomial model from weak star labels: up to 2 negative, 3 neutral, 4 and more positive."""
    star = F.col(star_col)
    labelled = df.select(
        F.col(text_col), F.when(star <= 2, 0.0).when(star < 4, 1.0).otherwise(2.0).alias("label")
    )
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[^\p{L}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol="label", maxIter=iterations, regParam=0.01, family="multinomial"
        ),
    ]).fit(labelled)


def apply_sentiment(df: DataFrame, model: PipelineModel) -> DataFrame:
    scored = model.transform(df).withColumn("_probability", vector_to_array("probability"))
    return (
        scored.withColumn("prob_negative", F.col("_probability")[0])
        .withColumn("prob_neutral", F.col("_probability")[1])
        .withColumn("prob_positive", F.col("_probability")[2])
        .select(*df.columns, "prob_negative", "prob_neutral", "prob_positive")
        .transform(sentiment_score)
    )


# ---- language ----------------------------------------------------------------------------


def detect_language(
    df: DataFrame, stop_words: Mapping[str, Sequence[str]] = fixed.LANGUAGE_STOP_WORDS,
    text_col: str = "review_text", out_col: str = "detected_lang", default: str = "en",
) -> DataFrame:
    """Stop-word vote; the earlier language on ties, ``default`` when no stop word occurs."""
    votes = {lang: f"_votes_{lang}" for lang in stop_words}
    counted = columns.lexicon_hits(df, text_col, {votes[lang]: words for lang, words in stop_words.items()})
    found = {lang: F.col(c) for lang, c in votes.items()}
    best = F.when(F.greatest(*found.values()) > 0, maths.first_max_label(found)).otherwise(default)
    return columns.compute_once(counted, {out_col: best}).drop(*votes.values())


def translate_selective(
    df: DataFrame,
    translate: Callable[[Column], Column],
    lang_col: str = "detected_lang",
    text_col: str = "review_text",
    max_chars: int | None = None,
) -> DataFrame:
    """Rewrite only non-English rows, in the same column, whole texts unless ``max_chars`` is given."""
    foreign = F.col(lang_col) != "en"
    return df.withColumn("was_translated", foreign).withColumn(
        text_col, F.when(foreign, translate(text.truncate(F.col(text_col), max_chars))).otherwise(F.col(text_col))
    )


def translate_with_scorer(
    df: DataFrame, factory: ScorerFactory, lang_col: str = "detected_lang", text_col: str = "review_text",
    max_chars: int | None = None, batch_size: int = 32,
) -> DataFrame:
    """The same with a plug-in model that returns ``translated``; English rows never reach it."""
    schema = T.StructType([T.StructField("translated", T.StringType())])
    foreign = df.filter(F.col(lang_col) != "en").withColumn(text_col, text.truncate(F.col(text_col), max_chars))
    done = (
        score_table(foreign, factory, schema, batch_size)
        .withColumn(text_col, F.col("translated"))
        .drop("translated")
        .withColumn("was_translated", F.lit(True))
    )
    kept = df.filter((F.col(lang_col) == "en") | F.col(lang_col).isNull()).withColumn("was_translated", F.lit(False))
    return kept.unionByName(done)


def dictionary_translator(words: Mapping[str, str]) -> Callable[[Column], Column]:
    """Word-for-word default for ``translate_selective``: listed words change, others stay."""

    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])

    def word(w: Column) -> Column:
        return F.coalesce(F.try_element_at(table, w), w)

    return lambda body: F.array_join(F.transform(F.split(body, " "), word), " ")


# ---- emotions ----------------------------------------------------------------------------


def score_emotions(
    df: DataFrame, lexicon: Mapping[str, Sequence[str]] = fixed.EMOTION_LEXICON,
    keep: Sequence[str] = fixed.ACTIVE_EMOTIONS, text_col: str = "review_text",
) -> DataFrame:
    """Class probabilities over every emotion of the lexicon, of which only ``keep`` become columns."""
    return emotions_from_hits(columns.lexicon_hits(df, text_col, emotion_columns(lexicon)), lexicon, keep)


def emotions_from_hits(
    counted: DataFrame, lexicon: Mapping[str, Sequence[str]] = fixed.EMOTION_LEXICON, keep: Sequence[str] = fixed.ACTIVE_EMOTIONS
) -> DataFrame:
    hits = {name: F.col(f"_emotion_{name}") for name in lexicon}
    total = sum(hits.values(), F.lit(0)) + 0.5 * len(lexicon)
    scored = counted.withColumns({f"emo_{name}": (hits[name] + 0.5) / total for name in keep})
    return scored.drop(*[f"_emotion_{n}" for n in lexicon]).transform(lambda d: dominant_emotion(d, keep))


def dominant_emotion(df: DataFrame, keep: Sequence[str] = fixed.ACTIVE_EMOTIONS) -> DataFrame:
    best = maths.first_max_label({e: F.col(f"emo_{e}") for e in keep})
    return df.withColumn("dominant_emotion", best).withColumn(
        "dominant_emotion_display",
        F.coalesce(*[F.when(F.col("dominant_emotion") == e, F.lit(fixed.EMOTION_DISPLAY.get(e, e))) for e in keep]),
    )
