"""Language identification learned from labelled rows: weights of letter trigrams as a table, joined and summed.

Any number of languages and scripts. Texts are counted by word first, and each distinct word of the corpus is scored once: what
is joined to the model is the vocabulary and not the texts, and a word that stands in every text is one row there. A text's score
for a language is the sum over its words. A text of which too few trigrams are known has an unknown language, not a default one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..session import read_back

UNKNOWN = "unknown"
#: Texts whose words a task counts together.
TEXTS = 500


@dataclass
class LanguageModel:
    """``grams``: trigram and ``weights``, its log probability in each of ``languages``."""

    languages: Sequence[str]
    grams: DataFrame


def word_counts(df: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """``keys``, ``word`` (a run of letters, lower case) and ``n``."""
    words = df.select(*keys, F.explode(text.letter_tokens(F.col(text_col))).alias("word")).where("word <> ''")
    return words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, tokens) a row (key, word, n) for each distinct word of each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            keys, tokens = (batch.column(i).slice(at, TEXTS) for i in (0, 1))
            words = pa.table({"row": pc.list_parent_indices(tokens), "word": pc.list_flatten(tokens)})
            words = words.filter(pc.not_equal(words["word"], "")).group_by(["row", "word"]).aggregate([("word", "count")]).combine_chunks()
            found = pa.table({"key": keys.take(words["row"]), "word": words["word"], "n": words["word_count"]})
            yield from found.combine_chunks().to_batches()


def text_word_counts(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``word_counts`` of each row by itself, counted where the text lies: rows that share a key bring a word once each."""
    rows = df.select(F.col(key), text.letter_tokens(F.col(text_col)).alias("tokens"))
    fields = [rows.schema[key], T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]
    return rows.where("tokens IS NOT NULL").mapInArrow(_count_words, T.StructType(fields))


def trigrams(word: Column) -> Column:
    """The trigrams of a word between two blanks, as many as it has letters."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))


def learn_languages(df: DataFrame, lang_col: str = "lang", text_col: str = "review_text") -> LanguageModel:
    """Add-one weights of all trigrams of the rows with a language, for each language."""
    spark = df.sparkSession
    counted = word_counts(df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_col), ["lang"], text_col)
    grams = counted.select("lang", "n", F.explode(trigrams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    grams = read_back(spark, grams, "gram-counts")
    totals = {r["lang"]: r["c"] for r in grams.groupBy("lang").agg(F.sum("c").alias("c")).collect()}
    languages, distinct = sorted(totals), grams.select("gram").distinct().count()
    own = [F.log((F.coalesce(F.max(F.when(F.col("lang") == lang, F.col("c"))), F.lit(0)) + 1) / F.lit(float(totals[lang] + distinct))) for lang in languages]
    weights = grams.groupBy("gram").agg(F.array(*own).cast("array<double>").alias("weights"))
    return LanguageModel(languages, read_back(spark, weights, "gram-weights"))


def word_scores(words: DataFrame, model: LanguageModel) -> DataFrame:
    """For each distinct ``word`` its number of ``known`` trigrams and their summed weight in each language (``s0``, ``s1``, ...)."""
    grams = words.select("word").distinct().select("word", F.explode(trigrams(F.col("word"))).alias("gram"))
    sums = [F.sum(F.col("weights")[i]).alias(f"s{i}") for i in range(len(model.languages))]
    return grams.join(model.grams, "gram").groupBy("word").agg(F.count(F.lit(1)).alias("known"), *sums)


def tell_languages(
    df: DataFrame, model: LanguageModel, key: str = "review_id", text_col: str = "review_text", least_known: float = 0.5
) -> DataFrame:
    """``key`` and ``detected_lang`` of every row: the language of the largest score, the first by name on ties.

    Texts of which under ``least_known`` of the trigrams are known, null texts and those without a letter are ``unknown``. Rows
    that share a key are one text.
    """
    spark = df.sparkSession
    every = df.select(F.col(key)).distinct()
    if not model.languages:
        return every.withColumn("detected_lang", F.lit(UNKNOWN))
    words = read_back(spark, text_word_counts(df, key, text_col), "word-counts")
    scores = word_scores(words, model)
    places = range(len(model.languages))
    sums = [F.sum(F.col("n") * F.coalesce(f"s{i}", F.lit(0.0))).alias(f"s{i}") for i in places]
    found = words.join(scores, "word", "left").groupBy(key).agg(
        F.sum(F.col("n") * F.length("word")).alias("all"), F.sum(F.col("n") * F.coalesce("known", F.lit(0))).alias("known"), *sums
    )
    rounded = [F.round(f"s{i}", 6) for i in places]
    best = F.greatest(*rounded) if len(rounded) > 1 else rounded[0]
    name = F.coalesce(*[F.when(s == best, F.lit(lang)) for s, lang in zip(rounded, model.languages, strict=True)])
    told = found.select(key, F.when(F.col("known") >= least_known * F.col("all"), name).otherwise(F.lit(UNKNOWN)).alias("detected_lang"))
    return every.join(told, every[key].eqNullSafe(told[key]), "left").select(every[key], F.coalesce("detected_lang", F.lit(UNKNOWN)).alias("detected_lang"))
