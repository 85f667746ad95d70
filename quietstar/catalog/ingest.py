"""Scans, header repair, defaults, sinks, dimension updates, unions and quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, labels, maths
from ..operators import quality, sampling
from ..plans import executive
from ..session import shared_dir
from ..sources import adapters as A, dimension, readers, schemas, sinks
from .common import labelled, lines, rounded, scored
from .sql import query, rnd, word_count

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def _scan(spark, sf):
    return readers.read_reviews(spark, f"{sf}/documents.parquet", schema=DOCUMENTS).select(
        "doc_id", "lang", "source", "n_chars", F.length("text").cast("bigint").alias("length")
    )


def _metadata(spark, sf):
    """Every part listed twice; products with a full-size order are wanted."""
    part = A.table(spark, sf, "part")
    pid = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    first = part.select(
        pid.alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
        F.array("p_type", "p_brand").alias("categories"), F.col("p_type").alias("main_category"), F.lit(1).alias("record_no"),
    )
    second = first.withColumns({"title": F.lit("relisted"), "brand": F.lit(""), "record_no": F.lit(2)})
    wanted = A.table(spark, sf, "lineitem").filter("l_quantity >= 50").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("product_id")
    )
    return readers.lookup_metadata(first.unionByName(second), wanted)


def _csv(spark, sf):
    path = shared_dir(spark, "csv-edge")
    source = A.table(spark, sf, "documents").select("doc_id", "lang", "text", "n_chars")
    source.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])
    return readers.read_csv(spark, path, schema).select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


def _headers(spark, sf):
    """Each language's dump under its own header variant, brought back to one schema."""
    r = A.reviews(spark, sf)
    variants = {
        "en": {"review_text": "text", "star_rating": "rating", "unix_time": "timestamp", "product_id": "parent_asin", "helpful_votes": "helpful_vote"},
        "de": {"review_text": "reviewText", "star_rating": "overall", "unix_time": "unixReviewTime", "product_id": "asin"},
        "fr": {"review_text": "content", "star_rating": "rating", "review_summary": "title"},
        "es": {},
    }
    # What has another language, or none, comes without a variant of its own.
    tongue = F.when(F.col("lang").isin("en", "de", "fr"), F.col("lang")).otherwise("es")
    frames = [
        readers.normalize_reviews(r.filter(tongue == lang).withColumnsRenamed(names)) for lang, names in variants.items()
    ]
    return sampling.pooled(frames).select(
        "review_id", "product_id", F.md5("review_text").alias("text_md5"), "star_rating", "unix_time", "helpful_votes"
    )


def _defaults(spark, sf):
    r = A.reviews(spark, sf)
    raw = r.select(
        "review_id",
        F.when(F.col("helpful_votes") == 0, "n/a").otherwise(F.col("helpful_votes").cast("string")).alias("helpful_votes"),
        F.when(F.col("star_rating") == 3, None).when(F.col("verified_purchase"), "True").otherwise("False").alias("verified_purchase"),
    )
    return readers.with_defaults(raw, {"helpful_votes": 0, "verified_purchase": False, "vine": False})


def _stage(spark, sf):
    path = shared_dir(spark, "stage")
    sinks.write_stage(lines(spark, sf), path, ["star_rating"])
    back = spark.read.parquet(path)
    return rounded(back.groupBy(F.col("star_rating").cast("double").alias("star_rating")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sentiment_score").alias("total"), F.countDistinct("product_id").alias("products")
    ), 4)


def _summary(spark, sf):
    """Executive documents written as JSON, read back with defaults, and flattened to aspects."""
    path = shared_dir(spark, "summary")
    sinks.write_json(executive.executive_summary(labelled(spark, sf), A.TECHNICAL, A.INSTRUCTIONAL), path)
    docs = readers.read_summary(spark, path, schemas.SUMMARY)
    return rounded(docs.select(
        "product_id", "total_reviews", "silent_killers", "revenue_at_risk_usd", "target_aspect",
        F.explode("priority_matrix").alias("m"),
    ).select(
        "product_id", "total_reviews", "silent_killers", "revenue_at_risk_usd", "target_aspect",
        "m.topic_label", "m.frequency_pct", "m.emotional_intensity", "m.quadrant",
    ), 4)


def _identity(spark, sf):
    """Brands of products ordered at full size; a title only for an even supplier."""
    li = A.table(spark, sf, "lineitem").filter("l_quantity >= 50")
    return li.groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("product_id")).agg(
        F.max("l_suppkey").alias("s")
    ).select(
        "product_id", F.concat(F.lit("Maker "), F.col("s").cast("string")).alias("brand"),
        F.when(F.col("s") % 2 == 0, F.concat(F.lit("Item "), F.col("s").cast("string"))).otherwise("").alias("title"),
    )


def _patch(spark, sf):
    return sinks.patch_products(A.parts(spark, sf), _identity(spark, sf))


def _updated(spark, sf):
    """The same through a stored dimension; the second update finds nothing to change."""
    path = shared_dir(spark, "dimension")
    dimension.create_dimension(A.parts(spark, sf), path, buckets=16)
    for _ in range(2):
        dimension.update_dimension(spark, path, _identity(spark, sf), sinks.patch_products)
    return dimension.read_dimension(spark, path)


def _invalid(spark, sf):
    r = A.reviews(spark, sf)
    holes = r.select(
        "review_id",
        F.when(F.trim("review_text") != "", F.col("review_text")).alias("review_text"),
        F.when(~((F.col("star_rating") == 3) & (F.col("helpful_votes") == 0)), F.col("review_date")).alias("review_date"),
    )
    return readers.drop_invalid(holes).select("review_id", dates.iso_day(F.col("review_date")).alias("day"))


def _times(spark, sf):
    """Epoch milliseconds, epoch seconds and date texts in one column."""
    r = A.reviews(spark, sf)
    raw = r.select("review_id", (
        F.when(F.col("star_rating") == 5, F.col("unix_time").cast("string"))
        .when(F.col("star_rating") == 4, (F.col("unix_time") / 1000).cast("bigint").cast("string"))
        .when(F.col("star_rating") == 1, "unknown")
        .otherwise(dates.iso_day(F.col("review_date")))
    ).alias("unix_time"))
    return readers.parse_review_time(raw).select(
        "review_id", F.coalesce(dates.iso_day(F.col("review_date")), F.lit("")).alias("day")
    )


def _embedded(spark, sf):
    r = A.reviews(spark, sf)
    sentence = F.when(F.col("star_rating") == 1, "Reviewed some time ago").otherwise(
        F.concat(F.lit("Reviewed in the United States on "), F.date_format("review_date", "MMMM d, yyyy"))
    )
    return r.select("review_id", F.coalesce(dates.iso_day(dates.embedded_date(sentence)), F.lit("")).alias("day"))


def _enrich(spark, sf):
    dim = A.parts(spark, sf).filter("category <> 'ECONOMY'")
    return readers.enrich(lines(spark, sf), dim, defaults={"brand": "Unknown", "title": "", "category": "Electronics"}).groupBy(
        "brand", "category"
    ).agg(F.count(F.lit(1)).alias("n"))


def _leaf(spark, sf):
    p = A.table(spark, sf, "part")
    cats = F.when(F.col("p_size") <= 10, F.array().cast("array<string>")).when(
        F.col("p_size") <= 20, F.array(F.lit("Electronics"), F.lit(""))
    ).otherwise(F.array(F.lit("Electronics"), F.col("p_type"), F.col("p_brand")))
    main = F.when(F.col("p_size") % 5 != 0, F.col("p_type"))
    return p.select("p_partkey", labels.leaf_category(cats, main).alias("category"))


def _pooled(spark, sf):
    a, b = scored(spark, sf).select("product_id", "star_rating", "prob_negative", "lang"), lines(spark, sf)
    return rounded(sampling.pooled([a, b]).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("lang").alias("with_text"), F.avg("prob_negative").alias("avg_negative")
    ))


def _row_ids(spark, sf):
    """Ids from the texts alone, so that every copied text is a repeat."""
    rows = readers.assign_review_ids(A.reviews(spark, sf), ["review_text"])
    return rows.select("review_id", F.md5("review_text").alias("text_md5"))


def _dedup(spark, sf):
    """All reviews and, again, the verified ones: two overlapping feeds."""
    r = A.reviews(spark, sf).select("review_id", "product_id", "star_rating")
    v = A.reviews(spark, sf).filter("verified_purchase").select("review_id", "product_id", "star_rating")
    return sampling.dedup(r.unionByName(v))


NULLABLE = ["review_text", "star_rating", "review_date", "product_id"]

QUERIES = {
    "scan_reviews": _scan,
    "metadata_lookup": _metadata,
    "scan_csv_typed": _csv,
    "scan_summary_json": _summary,
    "normalize_columns": _headers,
    "default_columns": _defaults,
    "write_stage_roundtrip": _stage,
    "patch_dimension": _patch,
    "update_dimension": _updated,
    "drop_invalid_rows": _invalid,
    "parse_review_time": _times,
    "extract_embedded_date": _embedded,
    "enrich_dimension": _enrich,
    "leaf_category": _leaf,
    "pooled_reviews": _pooled,
    "dedup_reviews": _dedup,
    "assign_review_ids": _row_ids,
    "star_distribution": lambda s, d: quality.value_counts(lines(s, d), "star_rating"),
    "distinct_counts": lambda s, d: quality.distinct_counts(A.reviews(s, d), ["product_id", "lang", "star_rating"]),
    "data_quality_report": lambda s, d: rounded(quality.quality_report(A.reviews(s, d), NULLABLE), 4),
    "month_bucket": lambda s, d: lines(s, d).select(
        dates.iso_day(dates.month_end(F.col("review_date"))).alias("month_end"), dates.year_month(F.col("review_date")).alias("year_month"),
        F.year("review_date").cast("bigint").alias("year"),
    ).groupBy("month_end", "year_month", "year").agg(F.count(F.lit(1)).alias("n")),
    "safe_math": lambda s, d: rounded(A.table(s, d, "lineitem").groupBy("l_partkey").agg(
        F.avg(F.col("l_discount") - F.col("l_tax")).alias("gap"), F.count_if(F.col("l_tax") == 0).alias("untaxed"),
        F.count(F.lit(1)).alias("n"),
    ).select(
        "l_partkey", F.log1p(F.col("n").cast("double")).alias("log_n"), F.ceil(F.col("n") / 7).cast("bigint").alias("weeks"),
        maths.clip(F.col("gap") * 100, -1.0, 1.0).alias("clipped"), (F.col("gap") / maths.safe_divisor(F.col("gap"))).alias("relative"),
        maths.ratio(F.col("n"), F.col("untaxed")).alias("per_untaxed"),
    )),
    "executive_summary_json": lambda s, d: sinks.as_json(
        executive.executive_summary(labelled(s, d), A.TECHNICAL, A.INSTRUCTIONAL)
    ).select(
        "product_id",
        F.get_json_object("document", "$.total_reviews").cast("bigint").alias("total_reviews"),
        F.get_json_object("document", "$.emotion_model.display_labels.sadness").alias("sadness_label"),
        F.get_json_object("document", "$.financials.silent_killers").cast("bigint").alias("silent_killers"),
        F.round(F.get_json_object("document", "$.financials.revenue_at_risk_usd").cast("double"), 2).alias("revenue_at_risk"),
        F.get_json_object("document", "$.roi_simulation.target_aspect").alias("target_aspect"),
        F.get_json_object("document", "$.priority_matrix[0].topic_label").alias("first_aspect"),
        F.get_json_object("document", "$.strategic_roadmap[0].tier").alias("first_tier"),
    ),
}

_TARGET = """(SELECT product_id, topic_label AS target_aspect FROM stats
   QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY round(mean_anger, 9) DESC, topic_label) = 1)"""

ORACLES = {
    "scan_reviews": "SELECT doc_id, lang, source, n_chars, length(text) AS length FROM documents",
    "metadata_lookup": """
        SELECT 'p' || p_partkey::varchar AS product_id, p_name AS title, p_brand AS brand, p_brand AS category
        FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)""",
    "scan_csv_typed": "SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents",
    "scan_summary_json": query(f"""
        SELECT product_id, total_reviews, silent_killers, round(revenue_at_risk, 2) AS revenue_at_risk_usd, target_aspect,
          topic_label, {rnd("frequency_pct", "frequency_pct", 4)}, {rnd("emotional_intensity", "emotional_intensity", 4)}, quadrant
        FROM matrix JOIN impact USING (product_id) JOIN {_TARGET} t USING (product_id)"""),
    "normalize_columns": query(
        "SELECT review_id, product_id, md5(review_text) AS text_md5, star_rating, unix_time, helpful_votes FROM reviews"
    ),
    "default_columns": query("""
        SELECT review_id, helpful_votes, verified_purchase AND star_rating <> 3 AS verified_purchase, false AS vine FROM reviews"""),
    "write_stage_roundtrip": query("""
        SELECT star_rating, count(*) AS n, round(sum(sentiment_score), 4) + 0 AS total, count(DISTINCT product_id) AS products
        FROM lines GROUP BY ALL"""),
    "patch_dimension": query("""
        SELECT parts.product_id, coalesce('Maker ' || s::varchar, brand) AS brand,
          CASE WHEN s % 2 = 0 THEN 'Item ' || s::varchar ELSE title END AS title, category
        FROM parts LEFT JOIN (SELECT 'p' || l_partkey::varchar AS product_id, max(l_suppkey) AS s FROM lineitem
                              WHERE l_quantity >= 50 GROUP BY ALL) i USING (product_id)"""),
    "drop_invalid_rows": query("""
        SELECT review_id, strftime(review_date, '%Y-%m-%d') AS day FROM reviews
        WHERE trim(review_text) <> '' AND NOT (star_rating = 3 AND helpful_votes = 0)"""),
    "parse_review_time": query("""
        SELECT review_id, CASE WHEN star_rating = 1 THEN '' ELSE strftime(review_date, '%Y-%m-%d') END AS day FROM reviews"""),
    "extract_embedded_date": query("""
        SELECT review_id, CASE WHEN star_rating = 1 THEN '' ELSE strftime(review_date, '%Y-%m-%d') END AS day FROM reviews"""),
    "enrich_dimension": query("""
        SELECT CASE WHEN category = 'ECONOMY' THEN 'Unknown' ELSE brand END AS brand,
          CASE WHEN category = 'ECONOMY' THEN 'Electronics' ELSE category END AS category, count(*) AS n
        FROM lines JOIN parts USING (product_id) GROUP BY 1, 2"""),
    "leaf_category": """
        SELECT p_partkey, CASE WHEN p_size > 20 THEN p_brand WHEN p_size % 5 <> 0 THEN p_type ELSE 'Electronics' END AS category
        FROM part""",
    "pooled_reviews": query(f"""
        SELECT product_id, count(*) AS n, count(lang) AS with_text, {rnd("avg(prob_negative)", "avg_negative")}
        FROM (SELECT product_id, prob_negative, lang FROM scored UNION ALL SELECT product_id, prob_negative, NULL FROM lines)
        GROUP BY ALL"""),
    "assign_review_ids": query("""
        SELECT md5(coalesce(review_text, '')) || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS review_id, md5(review_text) AS text_md5
        FROM (SELECT review_text, row_number() OVER (PARTITION BY coalesce(review_text, '') ORDER BY review_id) AS n FROM reviews)"""),
    "dedup_reviews": query("SELECT review_id, product_id, star_rating FROM reviews"),
    "star_distribution": query("SELECT star_rating, count(*) AS n FROM lines GROUP BY ALL"),
    "distinct_counts": query("""
        SELECT count(DISTINCT product_id) AS product_id, count(DISTINCT lang) AS lang, count(DISTINCT star_rating) AS star_rating
        FROM reviews"""),
    "data_quality_report": query(f"""
        SELECT "check", round(value, 4) AS value,
          CASE WHEN "check" LIKE 'null_pct_%' THEN value < 5 WHEN "check" IN ('invalid_stars', 'empty_texts') THEN value = 0
               WHEN "check" = 'rows' THEN value >= 1000 ELSE true END AS pass,
          CASE WHEN "check" <> 'rows' THEN '' WHEN value >= 10000 THEN 'excellent' WHEN value >= 5000 THEN 'meets minimum'
               WHEN value >= 1000 THEN 'workable' ELSE 'too small' END AS grade
        FROM (UNPIVOT (
          SELECT count(*)::double AS "rows",
            {", ".join(f"count_if({c} IS NULL) * 100.0::double / count(*) AS null_pct_{c}" for c in NULLABLE)},
            count_if(star_rating NOT IN (1, 2, 3, 4, 5))::double AS invalid_stars, avg(w)::double AS words_avg,
            min(w)::double AS words_min, max(w)::double AS words_max, count_if(trim(review_text) = '')::double AS empty_texts,
            year(min(review_date))::double AS first_year, year(max(review_date))::double AS last_year,
            quantile_cont(w, 0.5)::double AS words_median, count(DISTINCT product_id)::double AS products
          FROM (SELECT *, {word_count("review_text")} AS w FROM reviews)
        ) ON COLUMNS(*) INTO NAME "check" VALUE value)"""),
    "month_bucket": query("""
        SELECT strftime(last_day(review_date), '%Y-%m-%d') AS month_end, strftime(review_date, '%Y-%m') AS year_month,
          year(review_date) AS year, count(*) AS n FROM lines GROUP BY ALL"""),
    "safe_math": f"""
        SELECT l_partkey, {rnd("ln(1 + n)", "log_n")}, ceil(n / 7)::bigint AS weeks, {rnd("greatest(least(gap * 100, 1), -1)", "clipped")},
          {rnd("gap / CASE WHEN abs(gap) > 0.001 THEN abs(gap) ELSE 1 END", "relative")},
          {rnd("CASE WHEN untaxed = 0 THEN 0 ELSE n / untaxed END", "per_untaxed")}
        FROM (SELECT l_partkey, avg(l_discount - l_tax) AS gap, count_if(l_tax = 0)::bigint AS untaxed, count(*) AS n
              FROM lineitem GROUP BY ALL)""",
    "executive_summary_json": query(f"""
        SELECT product_id, total_reviews, 'Disappointment' AS sadness_label, silent_killers,
          round(revenue_at_risk, 2) AS revenue_at_risk, target_aspect, first_aspect, first_tier
        FROM impact JOIN {_TARGET} t USING (product_id)
        JOIN (SELECT product_id, min(topic_label) AS first_aspect,
                min(CASE WHEN emotional_intensity >= 0.40 * 1.5 THEN 'Short-Term (0-3 months)' ELSE 'Mid-Term (3-6 months)' END) AS first_tier
              FROM stats GROUP BY ALL) f USING (product_id)"""),
}

ORACLES["update_dimension"] = ORACLES["patch_dimension"]
