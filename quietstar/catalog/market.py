"""Discovery, rivals, identity and the competitor benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, labels
from ..operators import benchmark, discovery, identity
from ..plans import market
from ..session import read_back
from ..sources import adapters as A
from .common import lines, rounded, scored
from .sql import query, rnd, words

# Lower-case words of the synthetic text that stand in for the brand stop list.
COMMON = ["the", "of", "and", "in", "der", "die", "de", "la"]


def _chosen(spark, sf, **options):
    return market.select_products(A.reviews(spark, sf), A.parts(spark, sf), A.TYPE_KEYWORDS, **options)


def _products(spark, sf):
    """Flagship and rivals, a handful of rows read by several stages."""
    return read_back(spark, _chosen(spark, sf), "products")


def _compared(spark, sf):
    return market.competitor_benchmark(scored(spark, sf), _products(spark, sf))


def _candidates(spark, sf):
    """Rivals of the busiest order-line product: same category, another brand."""
    ranked = discovery.rank_products(discovery.reviews_per_product(lines(spark, sf)))
    dim = A.parts(spark, sf)
    types = dim.select("product_id", F.col("category").alias("product_type"))
    return discovery.competitors(ranked, types, dim).select("product_id", "review_count", "rank_no", "is_flagship", "is_fallback", "product_type", "brand")


def _names():
    """Distinct tokens of four and more letters outside the common words: the regex-free stand-in for names."""
    tokens = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("review_text"), r"[^\p{L}]+", " ")), " "))
    return F.filter(tokens, lambda w: (F.length(w) >= 4) & ~w.isin(*COMMON))


def _official(spark, sf):
    """Product dimension of the reviewed products; only some brands are on record."""
    ids = A.reviews(spark, sf).select("product_id").distinct()
    dim = A.parts(spark, sf).join(ids, "product_id", "left_semi")
    n = F.substring("product_id", 2, 9).cast("int")
    return dim.withColumn("brand", F.when(n % 3 == 0, F.col("brand")).when(n % 3 == 1, "Unknown").otherwise("")).withColumn(
        "title", F.when(n % 2 == 0, F.col("title")).otherwise("Unknown")
    )


def _identity(spark, sf, min_share=0.02):
    return identity.product_identity(_official(spark, sf), A.reviews(spark, sf), A.TYPE_KEYWORDS, min_share, _names())


def _resolve(spark, sf):
    """Resolution rules alone, on a brand guess per category."""
    dim = _official(spark, sf)
    n = F.substring("product_id", 2, 9).cast("int")
    brands = dim.filter(n < 9).select("product_id", F.concat(F.lit("Guess "), F.col("category")).alias("guessed_brand"))
    types = dim.filter(n % 2 == 1).select("product_id", F.lit("power bank").alias("product_type"))
    return identity.resolve_identity(dim, brands, types).select("product_id", "brand", "title", "brand_source")


QUERIES = {
    "reviews_per_product": lambda s, d: discovery.reviews_per_product(lines(s, d)),
    "flagship_ranking": lambda s, d: discovery.rank_products(discovery.reviews_per_product(lines(s, d))),
    "candidate_reviews": lambda s, d: discovery.candidate_reviews(
        lines(s, d), discovery.rank_products(discovery.reviews_per_product(lines(s, d)))
    ).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.avg("star_rating").alias("avg_star")).transform(rounded),
    "product_type_vote": lambda s, d: discovery.product_type_vote(A.reviews(s, d), A.TYPE_KEYWORDS),
    "competitor_candidates": _candidates,
    "cap_per_product": lambda s, d: discovery.cap_per_product(
        A.reviews(s, d), _products(s, d), flagship_cap=120, rival_cap=40
    ).select("product_id", "review_id", "arrival_no"),
    "discover_products": lambda s, d: market.discover_products(
        A.reviews(s, d), A.parts(s, d), keywords=A.TYPE_KEYWORDS
    ),
    "brand_guess": lambda s, d: rounded(identity.guess_brand(A.reviews(s, d), names=_names())),
    "brand_guess_names": lambda s, d: rounded(identity.guess_brand(A.reviews(s, d))),
    "resolve_identity": _resolve,
    "product_identity": lambda s, d: _identity(s, d).select("product_id", "brand", "title", "category", "brand_source"),
    "product_display_name": lambda s, d: _identity(s, d).select(
        "product_id", labels.display_name(F.col("brand"), F.col("title")).alias("display_name")
    ),
    "competitor_benchmark": lambda s, d: rounded(_compared(s, d)),
    "benchmark_gap": lambda s, d: rounded(benchmark.benchmark_gap(_compared(s, d))),
    "benchmark_insight": lambda s, d: rounded(market.benchmark_summary(scored(s, d), _products(s, d))),
}

_KEYS = ", ".join(f"'{k}'" for k in A.TYPE_KEYWORDS)


def _votes(body: str, name: str) -> dict[str, str]:
    return {
        f"{name}_hits": f"SELECT product_id, unnest(list_filter([{_KEYS}], lambda k: contains(lower({body}), k))) AS keyword FROM reviews",
        name: f"""
            SELECT product_id, keyword AS product_type, n AS votes FROM (
              SELECT product_id, keyword, count(*) AS n FROM {name}_hits GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY n DESC, list_position([{_KEYS}], keyword)) = 1""",
    }


_TYPE = _votes("review_summary || ' ' || review_text", "votes")
_RIVALS = _TYPE | {
    "ranked": """
        SELECT product_id, count(*) AS review_count, row_number() OVER (ORDER BY count(*) DESC, product_id) AS rank_no
        FROM reviews GROUP BY product_id QUALIFY rank_no <= 50""",
    "described": """
        SELECT r.*, v.product_type, title, brand, category, first(v.product_type) OVER w AS ft, first(brand) OVER w AS fb
        FROM ranked r LEFT JOIN votes v USING (product_id) LEFT JOIN parts USING (product_id)
        WINDOW w AS (ORDER BY rank_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "judged": """
        SELECT *, rank_no > 1 AND coalesce(product_type = ft, ft IS NULL) AND NOT coalesce(brand = fb, false) AS fits FROM described""",
    "chosen": """
        SELECT *, rank_no = 1 AS is_flagship FROM (
          SELECT *, rank_no > 1 AND (fits OR NOT any_fit) AS pick,
            count_if(rank_no > 1 AND (fits OR NOT any_fit)) OVER (ORDER BY rank_no) AS nth
          FROM (SELECT *, bool_or(fits) OVER () AS any_fit FROM judged)) WHERE rank_no = 1 OR (pick AND nth <= 4)""",
}
_CAPPED = _RIVALS | {
    "capped": """
        SELECT product_id, review_id, row_number() OVER (PARTITION BY product_id ORDER BY unix_time, review_id) AS arrival_no
        FROM reviews JOIN chosen USING (product_id) QUALIFY arrival_no <= CASE WHEN is_flagship THEN 120 ELSE 40 END""",
}
_BENCH = _RIVALS | {
    "scoped": "SELECT scored.* FROM scored JOIN chosen USING (product_id)",
    "shared": "SELECT CASE WHEN count(*) >= 10 THEN quantile_cont(prob_negative, 0.1) ELSE 0.5 END AS bar_value FROM scoped WHERE star_rating <= 2",
    "compared": """
        SELECT product_id, count(*) AS n_reviews, avg(star_rating) AS avg_star, avg(sentiment_score) AS avg_sentiment,
          avg((star_rating >= 4 AND prob_negative > prob_positive AND prob_negative >= bar_value)::int) * 100 AS silent_killer_rate_pct
        FROM scoped, shared GROUP BY ALL""",
    "gap": """
        SELECT count_if(NOT is_flagship)::bigint AS n_competitors, max(avg_sentiment) FILTER (is_flagship) AS fs,
          avg(avg_sentiment) FILTER (NOT is_flagship) AS cs, max(avg_star) FILTER (is_flagship) AS ft,
          avg(avg_star) FILTER (NOT is_flagship) AS ct FROM compared JOIN chosen USING (product_id)""",
}
_GAP = ", ".join(["n_competitors", rnd("fs", "flagship_avg_sentiment"), rnd("cs", "competitor_avg_sentiment"), rnd("ft", "flagship_avg_star"),
                  rnd("ct", "competitor_avg_star"), rnd("fs - cs", "sentiment_gap"), rnd("ft - ct", "star_gap")])
_NAMES = {
    "named": r"""
        SELECT product_id, unnest(list_filter(list_distinct(string_split(trim(regexp_replace(lower(review_text), '[^\p{L}]+', ' ', 'g')), ' ')),
          lambda w: length(w) >= 4 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in COMMON) + """))) AS word FROM reviews""",
    "guesses": """
        SELECT product_id, upper(word[1]) || word[2:] AS guessed_brand, n, n / total AS share
        FROM (SELECT product_id, word, count(*) AS n FROM named GROUP BY product_id, word
              QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY n DESC, word) = 1)
        JOIN (SELECT product_id, count(*) AS total FROM reviews GROUP BY ALL) USING (product_id) WHERE n / total >= 0.02""",
    "official": """
        SELECT product_id, category, CASE WHEN k % 3 = 0 THEN brand END AS brand, CASE WHEN k % 2 = 0 THEN title ELSE '' END AS title, k
        FROM (SELECT *, substr(product_id, 2)::int AS k FROM parts) WHERE product_id IN (SELECT product_id FROM reviews)""",
}
# RE2 has no look-behind: capitals that open a sentence are blanked first, and letters outside ASCII
# become word characters, so that a plain word pattern finds the mid-sentence names.
_CAPITALS = {
    "masked": r"""
        SELECT product_id, regexp_replace(regexp_replace(regexp_replace(replace(review_text, chr(160), ' '),
          '[^\P{L}\x00-\x7F]|\p{M}', '_', 'g'), '([.!?\n]\s)[A-Z]', '\1_', 'g'), '\A[A-Z]', '_') AS body FROM reviews""",
    "capitals": r"""
        SELECT product_id, unnest(list_filter(list_distinct(list_transform(regexp_extract_all(body, '\b([A-Z][a-z]{2,15})\b', 1),
          lambda w: lower(w))), lambda w: w NOT IN (""" + words(fixed.BRAND_STOP_WORDS) + """))) AS word FROM masked""",
    "named_guesses": """
        SELECT product_id, upper(word[1]) || word[2:] AS guessed_brand, n, n / total AS share
        FROM (SELECT product_id, word, count(*) AS n FROM capitals GROUP BY product_id, word
              QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY n DESC, word) = 1)
        JOIN (SELECT product_id, count(*) AS total FROM reviews GROUP BY ALL) USING (product_id) WHERE n / total >= 0.02""",
}
_IDENTITY = _NAMES | _votes("review_text", "body_votes") | {
    "resolved": """
        SELECT o.product_id, coalesce(brand, guessed_brand, 'Unknown') AS brand,
          CASE WHEN brand IS NULL AND guessed_brand IS NOT NULL AND title = ''
               THEN coalesce(upper(product_type[1]) || product_type[2:], '') ELSE title END AS title,
          category, CASE WHEN brand IS NOT NULL THEN 'metadata' WHEN guessed_brand IS NOT NULL THEN 'review-text (best-effort)'
                         ELSE 'unresolved' END AS brand_source
        FROM official o LEFT JOIN guesses USING (product_id) LEFT JOIN body_votes USING (product_id)""",
}

ORACLES = {
    "reviews_per_product": query("SELECT product_id, count(*) AS review_count FROM lines GROUP BY ALL"),
    "flagship_ranking": query("""
        SELECT *, rank_no = 1 AS is_flagship FROM (
          SELECT product_id, count(*) AS review_count, row_number() OVER (ORDER BY count(*) DESC, product_id) AS rank_no
          FROM lines GROUP BY product_id) WHERE rank_no <= 50"""),
    "candidate_reviews": query(f"""
        SELECT product_id, count(*) AS n, {rnd("avg(star_rating)", "avg_star")} FROM lines
        GROUP BY ALL ORDER BY n DESC, product_id LIMIT 50"""),
    "product_type_vote": query("SELECT * FROM votes", **_TYPE),
    "competitor_candidates": query("""
        SELECT product_id, review_count, rank_no, rank_no = 1 AS is_flagship, rank_no > 1 AND NOT any_fit AS is_fallback, category AS product_type, brand
        FROM (SELECT *, count_if(rank_no > 1 AND (fits OR NOT any_fit)) OVER (ORDER BY rank_no) AS nth
              FROM (SELECT *, bool_or(fits) OVER () AS any_fit
                    FROM (SELECT *, rank_no > 1 AND category = first(category) OVER w AND brand <> first(brand) OVER w AS fits
                          FROM (SELECT product_id, count(*) AS review_count, row_number() OVER (ORDER BY count(*) DESC, product_id) AS rank_no
                                FROM lines GROUP BY product_id QUALIFY rank_no <= 50) JOIN parts USING (product_id)
                          WINDOW w AS (ORDER BY rank_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))))
        WHERE rank_no = 1 OR ((fits OR NOT any_fit) AND nth <= 4)"""),
    "cap_per_product": query("SELECT product_id, review_id, arrival_no FROM capped", **_CAPPED),
    "discover_products": query("""
        SELECT product_id, title, brand, category, review_count AS scanned_review_count,
          (SELECT count(*) FROM reviews c WHERE c.product_id = chosen.product_id) AS sampled_review_count, is_flagship FROM chosen""", **_CAPPED),
    "brand_guess": query(f"SELECT product_id, guessed_brand, n, {rnd('share', 'share')} FROM guesses", **_NAMES),
    "brand_guess_names": query(f"SELECT product_id, guessed_brand, n, {rnd('share', 'share')} FROM named_guesses", **_CAPITALS),
    "resolve_identity": query("""
        SELECT product_id, coalesce(brand, CASE WHEN k < 9 THEN 'Guess ' || category END, 'Unknown') AS brand,
          CASE WHEN brand IS NULL AND k < 9 AND title = '' AND k % 2 = 1 THEN 'Power Bank' ELSE title END AS title,
          CASE WHEN brand IS NOT NULL THEN 'metadata' WHEN k < 9 THEN 'review-text (best-effort)' ELSE 'unresolved' END AS brand_source
        FROM official""", **_NAMES),
    "product_identity": query("SELECT product_id, brand, title, category, brand_source FROM resolved", **_IDENTITY),
    "product_display_name": query("""
        SELECT product_id, CASE WHEN brand = 'Unknown' THEN 'the flagship product' WHEN title = '' THEN brand || ' product'
          ELSE brand || ' ' || title END AS display_name FROM resolved""", **_IDENTITY),
    "competitor_benchmark": query(f"""
        SELECT product_id, n_reviews, {rnd("avg_star", "avg_star")}, {rnd("avg_sentiment", "avg_sentiment")},
          {rnd("silent_killer_rate_pct", "silent_killer_rate_pct")}, brand, title, category, is_flagship,
          brand || CASE WHEN is_flagship THEN ' (Flagship)' ELSE '' END AS label
        FROM compared JOIN chosen USING (product_id)""", **_BENCH),
    "benchmark_gap": query(f"SELECT {_GAP} FROM gap", **_BENCH),
    "benchmark_insight": query(f"""
        SELECT {_GAP}, 'Mean sentiment of the flagship: ' || printf('%.3f', abs(round(fs - cs, 3))) || CASE WHEN fs < cs THEN ' below' ELSE ' above' END
            || ' its rivals; difference in mean stars: ' || printf('%+.2f', round(ft - ct, 2)) AS insight,
          {rnd("bar_value", "sk_threshold_shared")} FROM gap, shared""", **_BENCH),
}
