"""Spark frames that several registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aspects, columns, sentiment, silent_killers
from ..session import read_back
from ..sources import adapters as A


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines; money and scores are float sums."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment.score_sentiment(A.reviews(spark, sf), A.LEXICON)


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return silent_killers.diagnose(scored(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Sentiment, aspects, emotions and flags from one tokenisation of each text."""
    classes = {
        **sentiment.sentiment_columns(A.LEXICON), **aspects.aspect_columns(A.ASPECTS), **sentiment.emotion_columns(A.EMOTIONS),
    }
    counted = columns.lexicon_hits(A.reviews(spark, sf), "review_text", classes)
    rows = sentiment.emotions_from_hits(
        aspects.aspects_from_hits(sentiment.sentiment_from_hits(counted), A.ASPECTS), A.EMOTIONS
    )
    # The bar needs star and sentiment only: counted apart so that it skips the other lexicons.
    return silent_killers.diagnose(rows, silent_killers.threshold_value(scored(spark, sf)))


def topical(spark: SparkSession, sf: str) -> DataFrame:
    return aspects.drop_outliers(labelled(spark, sf))


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return aspects.aspect_stats(topical(spark, sf))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return A.scored_lines(spark, sf)


def lines_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return silent_killers.diagnose(lines(spark, sf))


STAGE = (
    "review_id", "product_id", "star_rating", "review_date", "sentiment_score", "is_silent_killer", "revenue_at_risk",
    "star_gap", "helpful_votes", "verified_purchase", "review_length", "topic_id", "topic_label", "emo_anger", "emo_sadness",
    "emo_joy", "dominant_emotion", "dominant_emotion_display",
)


def labelled_stage(spark: SparkSession, sf: str) -> DataFrame:
    """``labelled`` without text, written once: for queries that read it several times."""
    full = labelled(spark, sf).withColumn("review_length", F.length("review_text").cast("bigint"))
    return read_back(spark, full.select(*STAGE), "labelled")


def topical_stage(spark: SparkSession, sf: str) -> DataFrame:
    return aspects.drop_outliers(labelled_stage(spark, sf))
