"""The registered queries of this subpackage and the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import decontamination, exact_dedup, katz, language, line_dedup, mixing, ngram_join, pii, prefix_trie, quality, term_search, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, ~C.held_out(F.col("id"), 5, 0))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", C.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels, ~C.held_out(F.col("id"), 3, 1))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", C.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), keep=("doc_id", "source"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "lines_cut", F.length("text").cast("long").alias("chars_kept"), F.sha2("text", 256).alias("text_sha256"))


#: Host, path, verdict.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language.tell_language(docs, language.learn(docs, ~C.held_out(F.col("id"), 3, 1)))
    return told.select("doc_id", C.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op11_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.katz_scores(table(spark, sf_dir, "documents"), ~C.held_out(F.col("id"), 7, 2))
    held = C.held_out(F.col("doc_id"), 7, 2).alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_source_mixing": op5_source_mixing,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_katz_scores": op11_katz_scores,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY body)""",
    "op12_ranked_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        s AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
        t AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size
              FROM (SELECT doc_id, len(terms) AS size, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
        w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, n),
        r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n) // l))))::BIGINT AS score
              FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY rank <= 50""",
    "op13_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
            FROM conversations WHERE conv_id IS NOT NULL),
        i AS (
            SELECT c, xor(4294967295, list_reduce(
                       list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 9 AS h
            FROM (SELECT DISTINCT c FROM t)),
        o AS (
            SELECT i.c, p, r, x FROM i JOIN t ON t.c = i.c - i.c % 5 AND p <= h
            UNION ALL SELECT i.c, 1000 + p, r, x FROM i JOIN t ON t.c = i.c AND p > h),
        s AS (SELECT c, coalesce(list(struct_pack(r := r, x := x) ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS s FROM i LEFT JOIN o USING (c) GROUP BY c),
        f AS (SELECT c, d, s[1:d] AS k, d = len(s) AS ends FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM s)),
        n AS (
            SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
            FROM f GROUP BY k, d),
        m AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
        b AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN m USING (k, d)),
        u AS (
            SELECT k[1:e] AS k, e AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
                   sum((n_convs - 1) * CASE WHEN d > 0 THEN strlen(k[d].x) ELSE 0 END)::BIGINT AS saved_tokens
            FROM (SELECT *, unnest(range(d + 1)) AS e FROM b) GROUP BY 1, 2)
        SELECT b.conv_id, b.d AS depth, a.conv_id AS parent_conv_id, b.n_convs, b.n_children, n_leaves, saved_tokens, b.ends_sha256
        FROM b JOIN u USING (k, d) LEFT JOIN n a ON a.d = b.d - 1 AND a.k = b.k[1:b.d - 1]""",
}
