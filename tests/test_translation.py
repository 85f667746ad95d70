"""Texts in pieces come back whole; the phrase table takes the longest phrase."""

import pandas as pd
from pyspark.sql import functions as F

from quietstar.operators import translation

ODD = ["", " ", "one", "One. Two!  Three?\n\nFour", "...", "no end " * 300, "x" * 1000, "a.b.c", "Ends here. ", "\n", "é" * 450 + " ü. ß", "a" * 399 + " b. c"]


def test_pieces_are_the_text_and_short(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", translation.pieces(F.col("t"), 40).alias("p"))
    for r in df.collect():
        assert "".join(r["p"]) == r["t"]
        assert all(len(p.rstrip()) <= 40 for p in r["p"]) and all(r["p"])


def test_texts_come_back_whole_from_a_batch_scorer(spark):
    loads, sizes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def factory():
        loads.add(1)

        def score(part: pd.DataFrame) -> pd.DataFrame:
            assert len(part) <= 3 and part["piece"].str.len().max() <= 60 and set(part["lang"]) <= {"de", "fr"}
            sizes.add(len(part))
            return part.assign(translated=part["piece"].str.swapcase())

        return score

    rows = [(i, "de" if i % 2 else "fr", t) for i, t in enumerate(ODD)] + [(50, "en", "Stay. As it is."), (51, None, "Nor this"), (52, "de", None), (53, "de", "One. Two!  Three?\n\nFour")]
    df = spark.createDataFrame(rows, "review_id long, detected_lang string, review_text string").repartition(2)
    got = {r["review_id"]: r for r in translation.translate_pieces(df, factory, limit=40, batch_size=3).collect()}
    for i, lang, t in rows:
        assert got[i]["review_text"] == (t.swapcase() if t and lang not in ("en", None) else t)
        assert got[i]["was_translated"] == (lang not in ("en", None))
    assert loads.value < sizes.value / 3  # a model for each task, not for each batch


def plain(body, phrases):
    out, i = "", 0
    letters = lambda c: c.isalnum()
    while i < len(body):
        if letters(body[i]):
            for p in sorted(phrases, key=len, reverse=True):
                end = i + len(p)
                if body[i:end].lower() == p and not (end < len(body) and letters(body[end])):
                    out, i = out + phrases[p], end
                    break
            else:
                end = i
                while end < len(body) and letters(body[end]):
                    end += 1
                out, i = out + body[i:end], end
        else:
            out, i = out + body[i], i + 1
    return out


def test_the_longest_phrase_wins(spark):
    phrases = {"in der regel": "as a rule", "in der": "in the", "der": "the", "regel": "rule", "c": "see"}
    bodies = ["In der Regel gut", "in der Regelung", "derb der DER.", "in  der", "(in der) regel c++", "", "Über der Regel", "inder der in der"] * 2
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = df.select("b", translation.phrase_translator(phrases)(F.col("b")).alias("t")).collect()
    assert [r["t"] for r in got] == [plain(r["b"], phrases) for r in got]
    assert got[0]["t"] == "as a rule gut" and got[1]["t"] == "in the Regelung"
