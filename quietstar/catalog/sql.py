"""DuckDB building blocks of the oracle queries: the same adapter views in SQL."""

from __future__ import annotations

import re

from ..sources import adapters as A


def h(value: str, salt: str) -> str:
    return f"('0x'||substr(md5({value}::varchar||'{salt}'),1,8))::bigint"


def words(items) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in items)


def rnd(expr: str, alias: str, n: int = 6) -> str:
    return f"round({expr}, {n}) + 0 AS {alias}"


def hits(items) -> str:
    return f"len(list_filter(tokens, lambda t: t IN ({words(items)})))"


def word_count(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '[^ \\t\\n\\x0b\\f\\r]+'))"


def argmax_case(pairs: list[tuple[str, str]], otherwise: str | None = None) -> str:
    """First column that equals the greatest one, as a CASE over (column, result)."""
    top = "greatest(" + ", ".join(c for c, _ in pairs) + ")"
    cases = " ".join(f"WHEN {c} = {top} THEN {r}" for c, r in pairs)
    return f"CASE WHEN {top} <= 0 THEN {otherwise} {cases} END" if otherwise is not None else f"CASE {cases} END"


TOKENS = r"string_split(trim(regexp_replace(lower(review_text), '[^\p{L}]+', ' ', 'g')), ' ')"
CLEAN = "trim(regexp_replace(lower(review_text), '[^a-z0-9]+', ' ', 'g'))"
_D = "(l_discount + l_tax + 0.05::double)"
_EMO_TOTAL = "(" + " + ".join(f"eh_{e}" for e in A.EMOTIONS) + f" + {0.5 * len(A.EMOTIONS)}::double)"

VIEWS = {
    "reviews": f"""
        SELECT doc_id AS review_id,
          'p' || least({h('doc_id', 'p')} % 12, {h('doc_id', 'q')} % 12)::varchar AS product_id,
          text AS review_text, lang, substr(text, 1, 60) AS review_summary,
          CASE WHEN {h('doc_id', 's')} % 100 < 8 THEN 1.0 WHEN {h('doc_id', 's')} % 100 < 16 THEN 2.0
               WHEN {h('doc_id', 's')} % 100 < 26 THEN 3.0 WHEN {h('doc_id', 's')} % 100 < 46 THEN 4.0
               ELSE 5.0 END::double AS star_rating,
          1609459200000 + ({h('doc_id', 'd')} % 730) * 86400000 AS unix_time,
          (date '2021-01-01' + ({h('doc_id', 'd')} % 730)::int)::date AS review_date,
          CASE WHEN {h('doc_id', 'h')} % 10 < 6 THEN 0 ELSE {h('doc_id', 'h')} % 200 END::bigint AS helpful_votes,
          {h('doc_id', 'v')} % 10 < 9 AS verified_purchase
        FROM documents""",
    "scored": f"""
        SELECT * EXCLUDE (tokens, p, q),
          (q + 0.5::double) / (p + q + 1.5::double) AS prob_negative,
          0.5::double / (p + q + 1.5::double) AS prob_neutral,
          (p + 0.5::double) / (p + q + 1.5::double) AS prob_positive,
          (p + 0.5::double) / (p + q + 1.5::double) - (q + 0.5::double) / (p + q + 1.5::double) AS sentiment_score
        FROM (SELECT *, {hits(A.POSITIVE)} AS p, {hits(A.NEGATIVE)} AS q
              FROM (SELECT *, {TOKENS} AS tokens FROM reviews))""",
    "bar": "SELECT quantile_cont(prob_negative, 0.1) AS threshold FROM scored WHERE star_rating <= 2",
    "flagged": """
        SELECT *, CASE WHEN is_silent_killer THEN 750.0::double * sk_weight ELSE 0.0::double END AS revenue_at_risk,
          (star_rating - 3) / 2 AS star_normalized, (star_rating - 3) / 2 - sentiment_score AS star_gap
        FROM (SELECT scored.*, (1 + ln(1 + helpful_votes)) * CASE WHEN verified_purchase THEN 1.2::double ELSE 1.0::double END
                AS sk_weight,
                star_rating >= 4 AND prob_negative > prob_positive AND prob_negative >= threshold AS is_silent_killer
              FROM scored, bar)""",
    "aspected": f"""
        SELECT * EXCLUDE (tokens, a0, a1, a2),
          {argmax_case([('a0', '0'), ('a1', '1'), ('a2', '2')], '-1')}::bigint AS topic_id,
          {argmax_case([('a0', "'Alpha'"), ('a1', "'Beta'"), ('a2', "'Gamma'")], "'Outlier'")} AS topic_label
        FROM (SELECT *, {", ".join(f"{hits(w)} AS a{i}" for i, (_, w) in enumerate(A.ASPECTS))}
              FROM (SELECT *, {TOKENS} AS tokens FROM flagged))""",
    "labelled": f"""
        SELECT *, {argmax_case([(f'emo_{e}', f"'{e}'") for e in ('anger', 'sadness', 'joy')])} AS dominant_emotion,
          {argmax_case([('emo_anger', "'Anger'"), ('emo_sadness', "'Disappointment'"), ('emo_joy', "'Joy'")])}
            AS dominant_emotion_display
        FROM (SELECT * EXCLUDE (tokens, {", ".join(f"eh_{e}" for e in A.EMOTIONS)}),
                {", ".join(f"(eh_{e} + 0.5::double) / {_EMO_TOTAL} AS emo_{e}" for e in ('anger', 'sadness', 'joy'))}
              FROM (SELECT *, {", ".join(f"{hits(w)} AS eh_{e}" for e, w in A.EMOTIONS.items())}
                    FROM (SELECT *, {TOKENS} AS tokens FROM aspected)))""",
    "topical": "SELECT * FROM labelled WHERE topic_id <> -1",
    "stats": """
        SELECT *, review_count / sum(review_count) OVER (PARTITION BY product_id) * 100 AS frequency_pct,
          mean_anger + mean_disapp AS emotional_intensity
        FROM (SELECT product_id, topic_label, count(*) AS review_count, avg(emo_anger) AS mean_anger,
                avg(emo_sadness) AS mean_disapp, avg(emo_joy) AS mean_joy, avg(sentiment_score) AS mean_sentiment
              FROM topical GROUP BY ALL)""",
    "matrix": """
        SELECT *, CASE WHEN frequency_pct >= 5 AND emotional_intensity >= 0.40 THEN 'Urgent Redesign'
                       WHEN emotional_intensity >= 0.40 THEN 'Quality Control Edge Case'
                       WHEN frequency_pct >= 5 THEN 'Marketing / Expectation Issue'
                       ELSE 'Monitor Only' END AS quadrant FROM stats""",
    "impact": """
        SELECT product_id, count(*) AS total_reviews, count_if(is_silent_killer)::bigint AS silent_killers,
          (count_if(is_silent_killer) * 5)::bigint AS invisible_churn, sum(revenue_at_risk) AS revenue_at_risk
        FROM topical GROUP BY ALL""",
    "ranked_aspects": """
        SELECT *, frequency_pct / sum(frequency_pct) OVER (PARTITION BY product_id) AS weight,
          row_number() OVER (PARTITION BY product_id ORDER BY round(emotional_intensity, 9) DESC, topic_label) AS rank_no
        FROM stats""",
    "monthly": """
        SELECT *, least(greatest(sk_count * 100.0::double / review_count, 0), 100) AS sk_rate,
          mean_anger + mean_sadness AS urgency
        FROM (SELECT product_id, last_day(review_date) AS month, count(sentiment_score) AS review_count,
                count_if(is_silent_killer)::bigint AS sk_count, avg(sentiment_score) AS mean_sentiment,
                avg(emo_anger) AS mean_anger, avg(emo_sadness) AS mean_sadness
              FROM labelled GROUP BY ALL) WHERE review_count >= 3""",
    "smoothed": """
        SELECT *, CASE WHEN count(mean_sentiment) OVER w >= 2 THEN avg(mean_sentiment) OVER w END AS smooth_sentiment,
          CASE WHEN count(sk_rate) OVER w >= 2 THEN avg(sk_rate) OVER w END AS smooth_sk_rate
        FROM monthly WINDOW w AS (PARTITION BY product_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "deltas": """
        SELECT *, smooth_sentiment - lag(smooth_sentiment) OVER (PARTITION BY product_id ORDER BY month) AS sentiment_delta
        FROM smoothed""",
    "lines": f"""
        SELECT 'p' || l_partkey::varchar AS product_id, (1 + l_quantity::int % 5)::double AS star_rating,
          l_discount / {_D} AS prob_negative, 0.05::double / {_D} AS prob_neutral, l_tax / {_D} AS prob_positive,
          l_tax / {_D} - l_discount / {_D} AS sentiment_score, l_linenumber::bigint AS helpful_votes,
          l_returnflag <> 'R' AS verified_purchase, l_shipdate::date AS review_date
        FROM lineitem""",
    "lines_bar": "SELECT quantile_cont(prob_negative, 0.1) AS threshold FROM lines WHERE star_rating <= 2",
    "lines_flagged": """
        SELECT *, CASE WHEN is_silent_killer THEN 750.0::double * sk_weight ELSE 0.0::double END AS revenue_at_risk,
          (star_rating - 3) / 2 AS star_normalized, (star_rating - 3) / 2 - sentiment_score AS star_gap
        FROM (SELECT lines.*, (1 + ln(1 + helpful_votes)) * CASE WHEN verified_purchase THEN 1.2::double ELSE 1.0::double END
                AS sk_weight,
                star_rating >= 4 AND prob_negative > prob_positive AND prob_negative >= threshold AS is_silent_killer
              FROM lines, lines_bar)""",
    "parts": """
        SELECT 'p' || p_partkey::varchar AS product_id, p_name AS title, p_brand AS brand, p_type AS category FROM part""",
    "arrivals": """
        SELECT event_id AS review_id, 'u' || user_id::varchar AS product_id, ts AS event_time,
          (1 + event_id % 5)::double AS star_rating,
          (json_extract(props, '$.k')::bigint + 1) / 102.0::double AS prob_negative,
          (101 - json_extract(props, '$.k')::bigint) / 204.0::double AS prob_positive, value
        FROM events""",
}


def query(body: str, **extra: str) -> str:
    """``body`` with a WITH clause of the views it needs, in dependency order."""
    pool = {**VIEWS, **extra}
    order: list[str] = []

    def need(sql: str) -> None:
        for name in pool:
            if name not in order and re.search(rf"\b{name}\b", sql):
                need(pool[name].replace(f" AS {name}", " "))
                if name not in order:
                    order.append(name)

    need(body)
    views = ",\n".join(f"{name} AS ({pool[name]})" for name in order)
    return f"WITH {views}\n{body}" if views else body
