"""Text functions, lexicon scorers, language, translation, complaints and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, labels, text
from ..operators import aspects, languages, quality, sentiment, summaries, translation
from ..session import read_back
from ..sources import adapters as A
from .common import flagged, labelled, rounded, scored
from .sql import CLEAN, TOKENS, h, hits, query, rnd, word_count

DICTIONARY = {"der": "the", "die": "the", "le": "the", "la": "the", "el": "the", "und": "and", "et": "and", "y": "and"}

#: Phrases of the synthetic texts, the longer ones before the words they are made of.
PHRASES = {"in der": "within the", "de la": "of the", "und die": "and also", "la": "the", "der": "the", "die": "this", "und": "and", "los": "those", "et les": "and their", "et": "plus"}


def _scores(spark, sf):
    """Label and score lists in a shuffled order and mixed case, back to named columns."""
    pairs = F.array(
        F.struct(F.lit("Positive").alias("label"), F.col("prob_positive").alias("score")),
        F.struct(F.lit("LABEL_NEGATIVE").alias("label"), F.col("prob_negative").alias("score")),
        F.struct(F.lit("neutral").alias("label"), F.col("prob_neutral").alias("score")),
    )
    listed = scored(spark, sf).select("review_id", F.when(F.col("star_rating") > 3, pairs).otherwise(F.reverse(pairs)).alias("scores"))
    return rounded(listed.select(
        "review_id", labels.score_for(F.col("scores"), "neg").alias("prob_negative"),
        labels.score_for(F.col("scores"), "neu").alias("prob_neutral"), labels.score_for(F.col("scores"), "pos").alias("prob_positive"),
    ))


def _languages(spark, sf):
    return sentiment.detect_language(A.reviews(spark, sf), A.LANGUAGES)


def _marked():
    """Stands for a model: what it gets comes back with one letter changed."""
    return lambda part: part.assign(translated=part["piece"].str.replace("e", "3", regex=False))


def _in_pieces(spark, sf):
    done = translation.translate_pieces(_languages(spark, sf).select("review_id", "detected_lang", "review_text"), _marked)
    return done.select("review_id", "was_translated", F.md5("review_text").alias("text_md5"))


def _learned_languages(spark, sf):
    """Four fifths of the rows are learned from; the language of all is told."""
    rows = A.reviews(spark, sf).select("review_id", "lang", "review_text").withColumn("held_out", A.salted_hash(F.col("review_id"), "l") % 5 == 0)
    model = languages.learn_languages(rows.where("NOT held_out"))
    return languages.tell_languages(rows, model).join(rows.select("review_id", "lang", "held_out"), "review_id")


def _sentiment_model(spark, sf):
    r = A.reviews(spark, sf)
    model = sentiment.fit_sentiment(r)
    return sentiment.apply_sentiment(r, model).select("review_id", "prob_negative", "prob_neutral", "prob_positive", "sentiment_score")


def _emotions(spark, sf):
    return rounded(sentiment.score_emotions(A.reviews(spark, sf), A.EMOTIONS).select(
        "review_id", "emo_anger", "emo_sadness", "emo_joy"
    ))


def _corpus(spark, sf):
    """Complaints are stored once: their count and their sample both read them."""
    rows = summaries.complaints(flagged(spark, sf)).select("product_id", "review_id", "review_text")
    return summaries.build_corpus(read_back(spark, rows, "complaints"), ["product_id"], fixed.SUMMARY_OVERALL_REVIEWS).select(
        "product_id", "n_complaints", "n_used", F.md5("corpus").alias("corpus_md5"), F.length("corpus").cast("bigint").alias("chars")
    )


def _summary(spark, sf):
    rows = summaries.complaints(aspects.drop_outliers(labelled(spark, sf)))
    rows = rows.select("product_id", "topic_label", "review_id", "review_text")
    return summaries.summarize(read_back(spark, rows, "complaints"))


def _overall_summary(spark, sf):
    rows = summaries.complaints(aspects.drop_outliers(labelled(spark, sf))).select("product_id", "review_id", "review_text")
    return summaries.summarize(read_back(spark, rows, "complaints"), ["product_id"])


QUERIES = {
    "clean_text": lambda s, d: A.reviews(s, d).select("review_id", text.clean_text(F.col("review_text")).alias("clean_text")),
    "text_lengths": lambda s, d: A.reviews(s, d).select(
        "review_id", text.word_count(F.col("review_text")).alias("words"), F.length("review_text").cast("bigint").alias("chars")
    ),
    "min_words": lambda s, d: aspects.with_clean_text(A.reviews(s, d)).select(
        "review_id", text.word_count(F.col("clean_text")).alias("words")
    ),
    "keyword_hits": lambda s, d: A.reviews(s, d).select(
        "review_id", F.array_join(text.keyword_hits(F.col("review_text"), A.TYPE_KEYWORDS), ",").alias("hits"),
        F.coalesce(text.first_keyword(F.col("review_text"), A.TYPE_KEYWORDS), F.lit("")).alias("first_hit"),
    ),
    "truncate_text": lambda s, d: A.reviews(s, d).groupBy("lang").agg(
        F.count_if(F.length("review_text") > fixed.TRANSLATE_MAX_CHARS).alias("truncated"),
        F.sum(F.length(text.truncate(F.col("review_text"), fixed.TRANSLATE_MAX_CHARS))).alias("chars_1500"),
        F.sum(F.length(text.truncate(F.col("review_text"), fixed.SUMMARY_MAX_CHARS))).alias("chars_3000"),
        F.sum(F.length(text.quote(F.col("review_text")))).alias("chars_quote"),
    ),
    "scores_to_columns": _scores,
    "sentiment_lexicon": lambda s, d: rounded(scored(s, d).select(
        "review_id", "prob_negative", "prob_neutral", "prob_positive", "sentiment_score"
    )),
    "sentiment_model": _sentiment_model,
    "detect_language": lambda s, d: _languages(s, d).select("review_id", "detected_lang"),
    "language_accuracy": lambda s, d: rounded(_languages(s, d).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("detected_lang")).cast("double")).alias("accuracy")
    )),
    "detect_language_learned": lambda s, d: _learned_languages(s, d).select("review_id", "detected_lang", "held_out"),
    "language_accuracy_learned": lambda s, d: rounded(_learned_languages(s, d).where("held_out").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("detected_lang")).cast("double")).alias("accuracy")
    )),
    "language_counts": lambda s, d: quality.value_counts(_languages(s, d), "detected_lang"),
    "translate_selective": lambda s, d: sentiment.translate_selective(
        _languages(s, d), sentiment.dictionary_translator(DICTIONARY)
    ).select("review_id", "was_translated", F.md5("review_text").alias("text_md5")),
    "emotion_scores": _emotions,
    "dominant_emotion": lambda s, d: sentiment.score_emotions(A.reviews(s, d), A.EMOTIONS).select(
        "review_id", "dominant_emotion", "dominant_emotion_display"
    ),
    "translate_phrases": lambda s, d: sentiment.translate_selective(
        _languages(s, d), translation.phrase_translator(PHRASES)
    ).select("review_id", "was_translated", F.md5("review_text").alias("text_md5")),
    "translate_pieces": _in_pieces,
    "complaints": lambda s, d: summaries.complaints(flagged(s, d)).select("review_id", "product_id"),
    "complaint_corpus": _corpus,
    "complaint_summary": _summary,
    "complaint_summary_overall": _overall_summary,
}

_DETECTED = "CASE WHEN greatest(v0, v1, v2, v3) = 0 THEN 'en' " + " ".join(
    f"WHEN v{i} = greatest(v0, v1, v2, v3) THEN '{lang}'" for i, lang in enumerate(A.LANGUAGES)
) + " END"
_LANG = f"""SELECT *, {_DETECTED} AS detected_lang
    FROM (SELECT *, {", ".join(f"{hits(w)} AS v{i}" for i, w in enumerate(A.LANGUAGES.values()))}
          FROM (SELECT *, {TOKENS} AS tokens FROM reviews))"""
_PHRASE_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in PHRASES.items()) + "}"
_PHRASED = {
    "tongues": _LANG,
    "cut_words": r"""
        SELECT review_id, detected_lang, review_text, CASE WHEN detected_lang <> 'en' THEN regexp_extract_all(review_text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') ELSE [] END AS parts FROM tongues""",
    # From left to right: two words that are a phrase, else one, else the part itself.
    "walked": f"""
        SELECT review_id, detected_lang, review_text, list_reduce(range(1, len(parts) + 1), lambda acc, i:
            CASE WHEN acc.skip > 0 THEN {{'skip': acc.skip - 1, 'out': acc.out}}
                 WHEN {_PHRASE_MAP}[lower(array_to_string(parts[i:i + 2], ''))] IS NOT NULL AND i + 2 <= len(parts)
                   THEN {{'skip': 2::bigint, 'out': list_append(acc.out, {_PHRASE_MAP}[lower(array_to_string(parts[i:i + 2], ''))])}}
                 ELSE {{'skip': 0::bigint, 'out': list_append(acc.out, coalesce({_PHRASE_MAP}[lower(parts[i])], parts[i]))}} END,
            {{'skip': 0::bigint, 'out': []::varchar[]}}).out AS done FROM cut_words""",
}
_LEARNED = {
    "letters": f"""
        SELECT review_id, lang, out, word, count(*) AS n
        FROM (SELECT review_id, lang, {h('review_id', 'l')} % 5 = 0 AS out, unnest({TOKENS}) AS word FROM reviews) WHERE word <> '' GROUP BY ALL""",
    "learned_grams": """
        SELECT lang, gram, sum(n)::bigint AS c FROM (SELECT lang, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3))) AS gram
        FROM letters WHERE NOT out AND lang IS NOT NULL) GROUP BY ALL""",
    "gram_totals": "SELECT lang, sum(c) AS total, (SELECT count(DISTINCT gram) FROM learned_grams) AS v FROM learned_grams GROUP BY ALL",
    "gram_weights": """
        SELECT gram, lang, ln((coalesce(c, 0) + 1) / (total + v)::double) AS w
        FROM (SELECT DISTINCT gram FROM learned_grams) CROSS JOIN gram_totals LEFT JOIN learned_grams USING (gram, lang)""",
    "word_grams": """
        SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3))) AS gram FROM (SELECT DISTINCT word FROM letters)""",
    "word_weights": "SELECT word, lang AS guess, sum(w) AS w, count(*) AS known FROM word_grams JOIN gram_weights USING (gram) GROUP BY ALL",
    "guesses": "SELECT review_id, guess, sum(n * w) AS score, sum(n * known) AS known FROM letters JOIN word_weights USING (word) GROUP BY ALL",
    "guessed": """
        SELECT review_id, guess, known FROM guesses QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY round(score, 6) DESC, guess) = 1""",
    "spelled": "SELECT review_id, sum(n * length(word)) AS every FROM letters GROUP BY ALL",
    "told_languages": f"""
        SELECT review_id, lang, {h('review_id', 'l')} % 5 = 0 AS held_out, CASE WHEN known >= 0.5 * every THEN guess ELSE 'unknown' END AS detected_lang
        FROM reviews LEFT JOIN guessed USING (review_id) LEFT JOIN spelled USING (review_id)""",
}
_WORD_CASE = "CASE " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for k, v in DICTIONARY.items()) + " ELSE w END"
_TYPES = ", ".join(f"CASE WHEN contains(lower(review_text), '{k}') THEN '{k}' END" for k in A.TYPE_KEYWORDS)
_COMPLAINT = "sentiment_score < -0.1 OR star_rating <= 2 OR is_silent_killer"


def _corpus_views(source: str, keys: str, n: int) -> dict[str, str]:
    return {
        "pool": f"""
            SELECT {keys}, review_id, body, {word_count("body")} >= 20 AS long,
              row_number() OVER (PARTITION BY {keys} ORDER BY {word_count("body")} >= 20 DESC, md5(review_id::varchar || '42'), review_id) AS n
            FROM (SELECT *, replace(regexp_replace(review_text, '\\A\\s+|\\s+\\z', '', 'g'), chr(10), ' ') AS body FROM {source} WHERE {_COMPLAINT})""",
        "gathered": f"""
            SELECT {keys}, list(body ORDER BY n) FILTER (body <> '' AND (long OR NOT any_long)) AS texts
            FROM (SELECT *, bool_or(long) OVER (PARTITION BY {keys}) AS any_long FROM pool WHERE n <= {n}) GROUP BY ALL""",
        "packed": f"""
            SELECT {keys}, texts, list_reduce(texts, lambda acc, t: CASE WHEN acc.used + length(t) <= 3000
                THEN {{'used': acc.used + length(t), 'kept': list_append(acc.kept, t)}} ELSE acc END,
                {{'used': 0::bigint, 'kept': []::varchar[]}}).kept AS kept FROM gathered""",
        "corpora": f"""
            SELECT {keys}, n_complaints, coalesce(len(kept), 0)::bigint AS n_used,
              CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ')
                   ELSE coalesce(substr((SELECT t FROM (SELECT unnest(texts) AS t) ORDER BY length(t), t LIMIT 1), 1, 3000), '') END AS corpus
            FROM packed JOIN (SELECT {keys}, count(*) AS n_complaints FROM {source} WHERE {_COMPLAINT} GROUP BY ALL) USING ({keys})""",
    }


def _summary_views(keys: str) -> dict[str, str]:
    return {
        "told": rf"""
            SELECT {keys}, review_id, replace(regexp_replace(review_text, '\A\s+|\s+\z', '', 'g'), chr(10), ' ') AS body
            FROM topical WHERE {_COMPLAINT}""",
        "totals": f"SELECT {keys}, count(*) AS n_complaints FROM told GROUP BY ALL",
        "said": f"""
            SELECT {keys}, review_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS sentence_no
            FROM (SELECT {keys}, review_id,
                    list_filter(list_transform(regexp_split_to_array(body, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM told)""",
        "sentences": f"SELECT {keys}, sentence, count(*) AS times, min(row(review_id, sentence_no)) AS place FROM said GROUP BY {keys}, sentence",
        "spoken": rf"""
            SELECT * FROM (SELECT {keys}, sentence, times,
                unnest(string_split(trim(regexp_replace(lower(sentence), '[^\p{{L}}]+', ' ', 'g')), ' ')) AS word FROM sentences) WHERE word <> ''""",
        "term_counts": f"SELECT {keys}, word, sum(times)::bigint AS tf FROM spoken GROUP BY ALL",
        "term_weights": f"""
            SELECT {keys}, word, tf * ln(1 + (SELECT count(*) FROM totals) / df) AS w
            FROM term_counts JOIN (SELECT word, count(*) AS df FROM term_counts GROUP BY ALL) USING (word)""",
        "sentence_ranks": f"""
            SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 6) DESC, place) AS n
            FROM (SELECT {keys}, sentence, avg(w) AS score FROM spoken JOIN term_weights USING ({keys}, word) GROUP BY ALL)
            JOIN sentences USING ({keys}, sentence)""",
        "best": f"SELECT {keys}, string_agg(sentence, '. ' ORDER BY place) AS summary FROM sentence_ranks WHERE n <= 2 GROUP BY {keys}",
        "summarised": f"SELECT {keys}, coalesce(summary, '') AS summary, n_complaints FROM totals LEFT JOIN best USING ({keys})",
    }


ORACLES = {
    "clean_text": query(f"SELECT review_id, {CLEAN} AS clean_text FROM reviews"),
    "text_lengths": query(f"SELECT review_id, {word_count('review_text')} AS words, length(review_text) AS chars FROM reviews"),
    "min_words": query(f"""
        SELECT review_id, words FROM (SELECT review_id, {word_count(CLEAN)} AS words FROM reviews) WHERE words >= 5"""),
    "keyword_hits": query(f"""
        SELECT review_id, concat_ws(',', {_TYPES}) AS hits, coalesce({_TYPES}, '') AS first_hit FROM reviews"""),
    "truncate_text": query("""
        SELECT lang, count_if(length(review_text) > 1500)::bigint AS truncated, sum(least(length(review_text), 1500))::bigint AS chars_1500,
          sum(least(length(review_text), 3000))::bigint AS chars_3000, sum(least(length(trim(review_text, ' ')), 300))::bigint AS chars_quote
        FROM reviews GROUP BY ALL"""),
    "scores_to_columns": query(f"""
        SELECT review_id, {rnd("prob_negative", "prob_negative")}, {rnd("prob_neutral", "prob_neutral")},
          {rnd("prob_positive", "prob_positive")} FROM scored"""),
    "sentiment_lexicon": query(f"""
        SELECT review_id, {rnd("prob_negative", "prob_negative")}, {rnd("prob_neutral", "prob_neutral")},
          {rnd("prob_positive", "prob_positive")}, {rnd("sentiment_score", "sentiment_score")} FROM scored"""),
    "detect_language": query("SELECT review_id, detected_lang FROM tongues", tongues=_LANG),
    "language_accuracy": query(f"""
        SELECT lang, count(*) AS n, {rnd("avg((lang = detected_lang)::int)", "accuracy")} FROM tongues GROUP BY ALL""", tongues=_LANG),
    "detect_language_learned": query("SELECT review_id, detected_lang, held_out FROM told_languages", **_LEARNED),
    "language_accuracy_learned": query(f"""
        SELECT lang, count(*) AS n, {rnd("avg((lang = detected_lang)::int)", "accuracy")} FROM told_languages WHERE held_out GROUP BY ALL""", **_LEARNED),
    "translate_phrases": query("""
        SELECT review_id, detected_lang <> 'en' AS was_translated, md5(CASE WHEN detected_lang = 'en' THEN review_text ELSE array_to_string(done, '') END) AS text_md5
        FROM walked""", **_PHRASED),
    "translate_pieces": query("""
        SELECT review_id, detected_lang <> 'en' AS was_translated, md5(CASE WHEN detected_lang = 'en' THEN review_text ELSE replace(review_text, 'e', '3') END) AS text_md5
        FROM tongues""", tongues=_LANG),
    "language_counts": query("SELECT detected_lang, count(*) AS n FROM tongues GROUP BY ALL", tongues=_LANG),
    "translate_selective": query(f"""
        SELECT review_id, detected_lang <> 'en' AS was_translated,
          md5(CASE WHEN detected_lang = 'en' THEN review_text ELSE
            array_to_string(list_transform(string_split(review_text, ' '), lambda w: {_WORD_CASE}), ' ') END) AS text_md5
        FROM tongues""", tongues=_LANG),
    "emotion_scores": query(f"""
        SELECT review_id, {rnd("emo_anger", "emo_anger")}, {rnd("emo_sadness", "emo_sadness")}, {rnd("emo_joy", "emo_joy")} FROM labelled"""),
    "dominant_emotion": query("SELECT review_id, dominant_emotion, dominant_emotion_display FROM labelled"),
    "complaints": query(f"SELECT review_id, product_id FROM flagged WHERE {_COMPLAINT}"),
    "complaint_corpus": query("""
        SELECT product_id, n_complaints, n_used, md5(corpus) AS corpus_md5, length(corpus) AS chars FROM corpora""",
        **_corpus_views("flagged", "product_id", 60)),
    "complaint_summary": query("SELECT * FROM summarised", **_summary_views("product_id, topic_label")),
    "complaint_summary_overall": query("SELECT * FROM summarised", **_summary_views("product_id")),
}
