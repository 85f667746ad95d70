"""Hand-made tables with known answers: boundaries, real-English rules and empty cases."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quietstar.functions import dates, fixed, labels, maths, text
from quietstar.operators import aspects, discovery, identity, quality, ranking, sampling, sentiment, strategy, summaries, trend
from quietstar.operators import silent_killers as sk
from quietstar.sources import readers


def _one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


def test_silent_killers_weights_and_money(spark):
    df = spark.createDataFrame(
        [("r1", 5.0, 0.70, 0.20, 9, True), ("r2", 4.0, 0.30, 0.20, 0, False), ("r3", 5.0, 0.25, 0.20, 0, True),
         ("r4", 5.0, 0.30, 0.60, 50, True), ("r5", 3.0, 0.90, 0.05, 4, True), ("r6", 4.0, 0.27, 0.25, 1, False)],
        "review_id string, star_rating double, prob_negative double, prob_positive double, helpful_votes long, verified_purchase boolean",
    )
    got = {r["review_id"]: r for r in sk.diagnose(sentiment.sentiment_score(df), 0.26).collect()}
    assert {k for k, r in got.items() if r["is_silent_killer"]} == {"r1", "r2", "r6"}
    assert [round(got[k]["sk_weight"], 6) for k in ("r1", "r2", "r3", "r4", "r5", "r6")] == [3.963102, 1.0, 1.2, 5.918191, 3.131325, 1.693147]
    assert [round(got[k]["revenue_at_risk"], 2) for k in ("r1", "r2", "r3", "r6")] == [2972.33, 750.0, 0.0, 1269.86]
    assert [round(got[k]["star_gap"], 2) for k in ("r1", "r2", "r3", "r4", "r5", "r6")] == [1.5, 0.6, 1.05, 0.7, 0.85, 0.52]


def test_threshold_interpolates_and_pools(spark):
    def frame(values):
        return spark.createDataFrame([(1.0, v) for v in values], "star_rating double, prob_negative double")

    assert sk.sk_threshold(frame([0.2, 0.4, 0.6, 0.8]), {"p": 0.10}).first()["p"] == pytest.approx(0.26)
    nine = frame([0.1 * i for i in range(1, 10)])
    assert sk.pooled_threshold([nine]).first()["threshold"] == 0.5
    assert sk.pooled_threshold([nine, frame([0.95])]).first()["threshold"] == pytest.approx(0.19)
    assert sk.pooled_threshold([frame([0.3]).filter("star_rating > 3")]).first() == Row(n_rows=0, threshold=0.5)


def test_ingest_repairs(spark):
    raw = spark.createDataFrame(
        [("a", "False", "x"), ("b", "True", "7"), ("c", None, None)], "review_text string, verified_purchase string, helpful_votes string"
    )
    got = readers.with_defaults(raw).orderBy("review_text").collect()
    assert [(r["verified_purchase"], r["helpful_votes"]) for r in got] == [(False, 0), (True, 7), (False, 0)]
    bare = readers.with_defaults(raw.select("review_text")).first()
    assert (bare["verified_purchase"], bare["helpful_votes"]) == (False, 0)

    times = spark.createDataFrame([("1559520000000",), ("1559520000",), ("2019-06-03",), ("soon",)], "unix_time string")
    assert [r["review_date"] for r in readers.parse_review_time(times).collect()] == [dt.date(2019, 6, 3)] * 3 + [None]
    assert _one(spark, dates.embedded_date(F.col("t")), t="Reviewed in the United States on June 3, 2019") == dt.date(2019, 6, 3)
    assert _one(spark, dates.embedded_date(F.col("t")), t="Reviewed on Smarch 40, 2019") is None

    nulls = spark.createDataFrame([(None, dt.date(2020, 1, 1)), ("ok", None), ("ok", dt.date(2020, 1, 1))], "review_text string, review_date date")
    assert readers.drop_invalid(nulls).count() == 1


@pytest.mark.parametrize("names", [
    ("text", "rating", "timestamp"), ("reviewText", "overall", "unixReviewTime"),
    ("review_text", "star_rating", "unix_time"), ("content", "rating", "timestamp"),
])
def test_header_variants(spark, names):
    df = spark.createDataFrame([("t", 5.0, 1)], list(names))
    assert set(readers.normalize_reviews(df).columns) == {"review_text", "star_rating", "unix_time"}


def test_missing_required_column_fails_at_plan_time(spark):
    with pytest.raises(ValueError, match="star_rating"):
        readers.require_columns(spark.range(1), ["id", "star_rating"])


@pytest.mark.parametrize("frequency, intensity, want", [
    (5.0, 0.40, "Urgent Redesign"), (4.99, 0.40, "Quality Control Edge Case"),
    (5.0, 0.399, "Marketing / Expectation Issue"), (4.99, 0.399, "Monitor Only"),
])
def test_quadrant_boundaries(spark, frequency, intensity, want):
    assert _one(spark, labels.quadrant(F.col("f"), F.col("i")), f=frequency, i=intensity) == want


@pytest.mark.parametrize("aspect, intensity, tier, action", [
    ("Connectivity", 0.61, "Short-Term (0-3 months)", "Firmware / Engineering Fix"),
    ("Comfort & Fit", 0.61, "Short-Term (0-3 months)", "Urgent Quality Review"),
    ("Connectivity", 0.599, "Mid-Term (3-6 months)", "Engineering Review"),
    ("Connectivity", 0.2681, "Mid-Term (3-6 months)", "Engineering Review"),
    ("Comfort & Fit", 0.267, "Mid-Term (3-6 months)", "Marketing Campaign / Tutorial Content"),
    ("Packaging", 0.267, "Mid-Term (3-6 months)", "UX / Design Improvement"),
])
def test_roadmap_boundaries(spark, aspect, intensity, tier, action):
    df = spark.range(1).select(F.lit(aspect).alias("a"), F.lit(intensity).alias("i"))
    got = df.select(labels.roadmap_tier(F.col("i")).alias("t"), labels.roadmap_action(F.col("a"), F.col("i")).alias("x")).first()
    assert (got["t"], got["x"]) == (tier, action)


def test_roi_simulation(spark):
    rows = [("p", "A", 0.9, s) for s in (-0.9, 0.3)] + [("p", "B", 0.1, s) for s in (0.5, 0.8, 0.1)]
    df = spark.createDataFrame(rows, "product_id string, topic_label string, emo_anger double, sentiment_score double").withColumns(
        {"emo_sadness": F.lit(0.1), "emo_joy": F.lit(0.1)}
    )
    got = strategy.roi_simulation(df, aspects.aspect_stats(df)).first()
    assert got["target_aspect"] == "A"
    assert got["baseline_sentiment"] == pytest.approx(0.16)
    assert (got["sentiment_neutral"], got["improvement_pct_low"]) == (pytest.approx(0.28), pytest.approx(75.0))
    assert (got["sentiment_positive"], got["improvement_pct_high"]) == (pytest.approx(0.46), pytest.approx(187.5))


def test_trend_smoothing_and_changepoint(spark):
    series = [0.5, 0.45, 0.5, 0.1, 0.05, 0.1, 0.0]
    rows = [("p", dt.date(2021, m, 15), s, False) for m, s in zip((1, 2, 4, 5, 6, 7, 8), series) for _ in range(5)]
    rows += [("p", dt.date(2021, 9, 1), -1.0, False)] * 2
    df = spark.createDataFrame(rows, "product_id string, review_date date, sentiment_score double, is_silent_killer boolean")
    monthly = trend.delta(trend.smooth(trend.monthly_metrics(df)))
    got = [round(r["smooth_sentiment"], 6) for r in monthly.orderBy("month").collect()]
    assert got == [0.483333, 0.3875, 0.32, 0.24, 0.15, 0.0625, 0.05]
    turn = trend.changepoint(monthly).first()
    assert turn["changepoint_month"] == dt.date(2021, 2, 28)
    assert turn["drop"] == pytest.approx(0.0958333)


@pytest.mark.parametrize("body, want", [
    ("I love my Senso buds. Sound is Great! Very Panasonic", ["senso", "panasonic"]),
    ("My Senso broke. Senso support is bad", ["senso"]), ("Great! Very loud", []), ("Better than Bose", []),
])
def test_brand_names(spark, body, want):
    assert _one(spark, text.mid_sentence_names(F.col("t")), t=body) == want


def test_brand_guess_needs_share(spark):
    rows = [("p", "I love my Senso buds")] + [("p", "nothing here")] * 60 + [("q", "the Senso one"), ("q", "a Senso two")]
    df = spark.createDataFrame(rows, "product_id string, review_text string")
    assert [(r["product_id"], r["guessed_brand"]) for r in identity.guess_brand(df).collect()] == [("q", "Senso")]


def test_product_type_is_a_majority(spark):
    rows = [("p", "", "no charger in the box")] + [("p", "", "nice headphones")] * 3 + [("p", "", "nothing")]
    df = spark.createDataFrame(rows, "product_id string, review_summary string, review_text string")
    assert discovery.product_type_vote(df).first()["product_type"] == "headphone"


def test_identity_resolution(spark):
    products = spark.createDataFrame(
        [("a", "Acme", "Buds"), ("b", "Unknown", "Unknown"), ("c", None, "Cable X"), ("d", "", None)],
        "product_id string, brand string, title string",
    )
    brands = spark.createDataFrame([("b", "Senso"), ("c", "Zed")], "product_id string, guessed_brand string")
    types = spark.createDataFrame([("b", "headphones")], "product_id string, product_type string")
    got = {r["product_id"]: (r["brand"], r["title"], r["brand_source"]) for r in identity.resolve_identity(products, brands, types).collect()}
    assert got == {
        "a": ("Acme", "Buds", "metadata"), "b": ("Senso", "Headphones", "review-text (best-effort)"),
        "c": ("Zed", "Cable X", "review-text (best-effort)"), "d": ("Unknown", "", "unresolved"),
    }


def _corpus(spark, texts, budget):
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "product_id string, review_id long, review_text string")
    return summaries.build_corpus(df, ["product_id"], max_chars=budget).first()


def test_corpus_packing(spark):
    packed = _corpus(spark, ["aaaa", "bbbbbbb", "cc", "dddd"], 10)
    assert sorted(packed["corpus"].split(" ")) in (["aaaa", "cc", "dddd"], ["bbbbbbb", "cc"])
    assert _corpus(spark, ["aaaaaaaaaaaa", "bbbbbbbbbbb"], 10)["corpus"] == "bbbbbbbbbb"
    long = " ".join(["word"] * 25)
    assert _corpus(spark, ["short", long], 3000)["corpus"] == long


def test_clean_text(spark):
    assert _one(spark, text.clean_text(F.col("t")), t="Great  Sound!!  5-star <br />OK") == "great sound 5 star br ok"


def test_auroc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.4), (0, 0.1)], "label int, score double")
    assert ranking.auroc(df, "score", "label").first()["auroc"] == pytest.approx(2 / 3)
    assert ranking.auroc(df.filter("label = 0"), "score", "label").first()["auroc"] is None


def test_stratified_sample_allocation(spark):
    rows = [(i, s) for i, s in enumerate([1.0] * 3 + [2.0] * 7 + [3.0] * 13)]
    df = spark.createDataFrame(rows, "review_id long, star_rating double")
    got = {r["star_rating"]: r["n"] for r in quality.value_counts(sampling.stratified_sample(df, limit=10), "star_rating").collect()}
    assert got == {1.0: 1, 2.0: 3, 3.0: 5}
    assert sampling.stratified_sample(df, limit=23).count() == 23


@pytest.mark.parametrize("n, want", [(100, 80), (1000, 278), (5007, 357), (500000, 384), (500, 218)])
def test_cochran(spark, n, want):
    assert _one(spark, maths.cochran_n(F.col("n")), n=n) == want


@pytest.mark.parametrize("star, score, want", [
    (5.0, -0.1, "Silent Killers"), (4.0, 0.5, "Loyalists"), (2.0, -0.2, "Vocal Detractors"), (3.0, -0.2, "At Risk"),
    (4.0, 0.2, "Other"), (3.0, 0.1, "Other"), (2.0, 0.0, "Other"),
])
def test_segments(spark, star, score, want):
    assert _one(spark, labels.segment(F.col("a"), F.col("b")), a=star, b=score) == want


def test_scores_to_columns_ignores_order_and_case(spark):
    df = spark.createDataFrame(
        [([("POSITIVE", 0.2), ("Label_Neg", 0.7), ("neutral", 0.1)],)], "s array<struct<label: string, score: double>>"
    )
    got = df.select(*[labels.score_for(F.col("s"), k).alias(k) for k in ("neg", "neu", "pos")]).first()
    assert tuple(got) == (0.7, 0.1, 0.2)


def test_keyword_aspects_and_labels(spark):
    df = spark.createDataFrame(
        [(1, "the battery and charging died"), (2, "sound and bass, battery too"), (3, "hello world")], "review_id long, review_text string"
    )
    got = {r["review_id"]: r["topic_label"] for r in aspects.keyword_aspects(df).collect()}
    assert got == {1: "Battery & Charging", 2: "Sound Quality", 3: "Outlier"}
    terms = spark.createDataFrame(
        [(0, "bass", 1), (0, "audio", 2), (0, "fit", 3), (2, "zzz", 1), (7, "zzz", 1), (-1, "bass", 1)], "topic_id long, term string, rank_no long"
    )
    named = {r["topic_id"]: r["topic_label"] for r in aspects.label_topics(terms).collect()}
    assert named == {0: "Sound Quality", 2: "Battery & Charging", 7: "Aspect 8", -1: "Outlier"}


def test_language_and_translation(spark):
    df = spark.createDataFrame([(1, "der hund und die katze"), (2, "the cat and the dog"), (3, "12345")], "review_id long, review_text string")
    tongues = sentiment.detect_language(df)
    assert {r["review_id"]: r["detected_lang"] for r in tongues.collect()} == {1: "de", 2: "en", 3: "en"}
    done = sentiment.translate_selective(tongues, sentiment.dictionary_translator({"hund": "dog", "und": "and"}))
    got = {r["review_id"]: (r["review_text"], r["was_translated"]) for r in done.collect()}
    assert got[1] == ("der dog and die katze", True)
    assert got[2] == ("the cat and the dog", False)

    def upper():
        return lambda frame: frame.assign(translated=frame["review_text"].str.upper())

    plugged = {r["review_id"]: r["review_text"] for r in sentiment.translate_with_scorer(tongues, upper).collect()}
    assert plugged == {1: "DER HUND UND DIE KATZE", 2: "the cat and the dog", 3: "12345"}


def test_competitors_prefer_type_and_other_brand_then_fall_back(spark):
    ranked = spark.createDataFrame(
        [(f"p{i}", 100 - i, i + 1, i == 0) for i in range(6)], "product_id string, review_count long, rank_no long, is_flagship boolean"
    )
    products = spark.createDataFrame(
        [("p0", "t", "Acme", "c"), ("p1", "t", "Acme", "c"), ("p2", "t", "Unknown", "c"), ("p3", "webcam 4k", "Bolt", "c")],
        "product_id string, title string, brand string, category string",
    )
    types = spark.createDataFrame([(f"p{i}", "webcam") for i in (0, 1, 2)] + [("p4", "mouse")], "product_id string, product_type string")
    got = discovery.competitors(ranked, types, products)
    assert [r["product_id"] for r in got.orderBy("rank_no").collect()] == ["p0", "p2", "p3"]
    none = discovery.competitors(ranked, types.filter("product_id IN ('p0', 'p4')"), products.filter("product_id = 'p0'"), 2)
    rows = none.orderBy("rank_no").collect()
    assert [(r["product_id"], r["is_fallback"]) for r in rows] == [("p0", False), ("p1", True), ("p2", True)]


def test_display_names(spark):
    df = spark.createDataFrame([("Acme", "Buds"), ("Acme", ""), ("Unknown", "Buds"), (None, None)], "b string, t string")
    got = [r["x"] for r in df.select(labels.display_name(F.col("b"), F.col("t")).alias("x")).collect()]
    assert got == ["Acme Buds", "Acme product", "the flagship product", "the flagship product"]


def test_fixed_formula_columns_are_not_features():
    assert not set(fixed.CHURN_FEATURES) & set(fixed.LABEL_FORMULA_COLUMNS)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("a", 5.0, 0.1), ("a", 5.0, 0.4), ("b", 1.0, -1.0), ("b", 5.0, 1.0)], "k string, star_rating double, sentiment_score double")
    got = {r["k"]: (r["pearson_r"], r["weak_correlation"]) for r in sk.star_sentiment_corr(df, ["k"]).collect()}
    assert got["a"] == (None, False)
    assert got["b"] == (pytest.approx(1.0), False)


def test_row_ids_number_repeats(spark):
    rows = [("p1", 5, "good")] * 7 + [("p1", 5, None), ("p2", 5, "good"), ("p1", None, "good")]
    df = spark.createDataFrame(rows, "product_id string, unix_time long, review_text string").repartition(4)
    got = readers.assign_review_ids(df).collect()
    ids = [r["review_id"] for r in got]
    assert len(set(ids)) == len(rows)
    hot = [r["review_id"] for r in got if (r["product_id"], r["unix_time"], r["review_text"]) == rows[0]]
    assert sorted(i[32:] for i in hot) == ["", "-2", "-3", "-4", "-5", "-6", "-7"]
    assert len({i[:32] for i in ids}) == 4
    assert readers.assign_review_ids(df.limit(0)).count() == 0


def test_top_per_group_beyond_a_thousand(spark):
    df = spark.range(3000).withColumn("k", F.lit(1))
    got = ranking.top_per_group(df, ["k"], [F.desc("id")], 1500)
    assert got.agg(F.count("id"), F.min("id"), F.max("rank_no")).first() == (1500, 1500, 1500)


def test_dates_inside_sentences(spark):
    df = spark.createDataFrame([("Reviewed in Italy on June 3, 2019",), ("2020-01-02",), ("never",)], "unix_time string")
    got = [r["review_date"] for r in readers.parse_review_time(df).collect()]
    assert [d and d.isoformat() for d in got] == ["2019-06-03", "2020-01-02", None]


def test_summary_reads_every_complaint(spark):
    """One sentence that many reviews repeat beats the rest, wherever it stands; groups without sentences keep a row."""
    rows = [(1, i, f"Odd{chr(97 + i % 26)}{chr(97 + i // 26)} start. The lid broke") for i in range(200)] + [(2, 1, ""), (2, 2, None)]
    df = spark.createDataFrame(rows, "product_id long, review_id long, review_text string")
    got = {r["product_id"]: r for r in summaries.summarize(df, ["product_id"], sentences=1).collect()}
    assert (got[1]["summary"], got[1]["n_complaints"]) == ("The lid broke", 200)
    assert (got[2]["summary"], got[2]["n_complaints"]) == ("", 2)
