"""Learned language identification against a plain version, over scripts it knows and one it does not."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quietstar.operators import languages

LETTERS = {"en": "etaoinshr", "ru": "оеаинтсрв", "el": "αοιετσνηυ", "ja": "のにはをたがでてと", "de": "enisratdh", "pl": "aioezyłnw"}


@pytest.fixture(scope="module")
def texts(spark):
    draw, rows = random.Random(3), []
    for lang, letters in LETTERS.items():
        words = ["".join(draw.choices(letters, [1 / (i + 1) for i in range(len(letters))], k=draw.randint(1, 6))) for _ in range(80)]
        rows += [(len(rows) + i, lang, " ".join(draw.choices(words, k=draw.randint(3, 30))).capitalize() + ".") for i in range(40)]
    rows += [(900, None, None), (901, "en", ""), (902, "en", "12 34 !"), (903, None, "Հայերեն լեզու է"), (904, None, "the")]
    return rows, spark.createDataFrame(rows, "review_id long, lang string, review_text string")


def plain(rows, learned):
    tokens = lambda t: [w for w in re.split(r"[^\w]+|[\d_]+", (t or "").lower()) if w]
    grams = lambda w: [f" {w} "[i : i + 3] for i in range(len(w))]
    counts = {}
    for i, lang, t in rows:
        if lang and learned(i):
            counts.setdefault(lang, Counter()).update(g for w in tokens(t) for g in grams(w))
    counts = {k: c for k, c in counts.items() if c}
    known = set().union(*counts.values())
    out = {}
    for i, _, t in rows:
        every = [g for w in tokens(t) for g in grams(w)]
        have = [g for g in every if g in known]
        if not every or len(have) < 0.5 * len(every):
            out[i] = "unknown"
            continue
        score = {k: round(sum(math.log((c[g] + 1) / (sum(c.values()) + len(known))) for g in have), 6) for k, c in counts.items()}
        out[i] = min(score, key=lambda k: (-score[k], k))
    return out


def test_languages_equal_a_plain_version(texts):
    rows, df = texts
    model = languages.learn_languages(df.where("review_id % 4 <> 0"))
    got = {r["review_id"]: r["detected_lang"] for r in languages.tell_languages(df.repartition(5), model).collect()}
    assert got == plain(rows, lambda i: i % 4)
    told = [(lang, got[i]) for i, lang, _ in rows if i % 4 == 0 and i < 900]
    assert sum(a == b for a, b in told) / len(told) > 0.95
    assert {got[i] for i in (900, 901, 902, 903)} == {"unknown"}


def test_nothing_learned_is_unknown(texts):
    _, df = texts
    model = languages.learn_languages(df.limit(0))
    assert {r["detected_lang"] for r in languages.tell_languages(df, model).collect()} == {"unknown"}
    known = languages.learn_languages(df)
    assert languages.tell_languages(df.limit(0), known).count() == 0


def test_one_very_common_word_is_scored_once(spark, texts):
    _, df = texts
    model = languages.learn_languages(df)
    words = spark.createDataFrame([(i, "the", 1) for i in range(500)] + [(1, "der", 2)], "review_id long, word string, n long")
    scores = languages.word_scores(words, model)
    assert scores.count() == 2 and scores.where(F.col("word") == "the").first()["known"] <= 3
