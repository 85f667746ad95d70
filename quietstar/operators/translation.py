"""Translation of whole texts in pieces, and a phrase table as the default translator.

A text is cut at sentence ends, long sentences at blanks, into pieces that put together again are the text. Pieces are scored in
batches of one plug-in model a task and joined by their places, so a model with a short window reads texts of any length, and a
text that stands in many rows is translated once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import read_back
from .sentiment import ScorerFactory, score_table

SENTENCE = r"(?s)[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+"
PIECE_CHARS = 400
WORD = r"[\p{L}\p{N}]"


def pieces(body: Column, limit: int = PIECE_CHARS) -> Column:
    """Consecutive parts of a text of at most ``limit`` characters and the blanks after them."""
    sentences = F.regexp_extract_all(body, F.lit(SENTENCE), 0)
    cut = rf"(?s).{{1,{limit}}}(?:\s+|\z)|.{{1,{limit}}}"
    return F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(cut), 0))))


def phrase_translator(phrases: Mapping[str, str]) -> Callable[[Column], Column]:
    """Replaces the longest listed phrase that begins at a word, whole words only, whatever their case; all else stays.

    ``phrases``: lower-case words with one blank between them, to their translation.
    """
    table = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    listed = "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    # At a word's first letter: a phrase, else the word; then what stands between words.
    parts = rf"(?iu)(?:{listed})(?!{WORD})|{WORD}+|[^\p{{L}}\p{{N}}]+"
    found = lambda part: F.coalesce(F.try_element_at(table, F.lower(part)), part)
    return lambda body: F.array_join(F.transform(F.regexp_extract_all(body, F.lit(parts), 0), found), "")


def translate_pieces(
    df: DataFrame, factory: ScorerFactory, lang_col: str = "detected_lang", text_col: str = "review_text", limit: int = PIECE_CHARS, batch_size: int = 32,
) -> DataFrame:
    """Rows whose language isn't ``en`` with their text translated, and ``was_translated``; English rows never reach the model.

    The scorer gets ``lang`` and ``piece`` and returns ``translated``. Null and empty texts stay; a null language is left alone.
    """
    spark = df.sparkSession
    digest = F.sha2(F.col(text_col), 256)
    foreign = (F.col(lang_col) != "en") & (F.length(text_col) > 0)
    rows = df.withColumn("_own", F.when(foreign, digest)).withColumn("was_translated", F.coalesce(F.col(lang_col) != "en", F.lit(False)))
    texts = rows.where("_own IS NOT NULL").select(F.col(lang_col).alias("lang"), "_own", F.col(text_col).alias("body")).dropDuplicates(["lang", "_own"])
    cut = texts.select("lang", "_own", F.posexplode(pieces(F.col("body"), limit)).alias("place", "piece"))
    scored = score_table(cut, factory, T.StructType([T.StructField("translated", T.StringType())]), batch_size)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "translated"))), lambda p: p["translated"]), "")
    done = read_back(spark, scored.groupBy("lang", "_own").agg(whole.alias("_whole")), "translated")
    done = done.withColumnRenamed("lang", "_lang").withColumnRenamed("_own", "_done")
    out = rows.join(done, (F.col(lang_col) == F.col("_lang")) & (F.col("_own") == F.col("_done")), "left")
    return out.withColumn(text_col, F.coalesce("_whole", text_col)).drop("_own", "_lang", "_done", "_whole")
