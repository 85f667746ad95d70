"""Plan shape: pruning, pushdown, and no row-level funnel through one task."""

import re

import pytest
from pyspark.sql import functions as F

from quietstar import catalog
from quietstar.catalog import common
from quietstar.operators import aspects, silent_killers as sk
from quietstar.sources import adapters as A

QUERIES = catalog.queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [
    "silent_killers", "silent_killer_diagnosis", "revenue_at_risk", "aspect_stats", "emotion_heatmap", "monthly_metrics",
    "temporal_trend", "discover_products", "competitor_benchmark", "product_identity", "stratified_sample", "auroc_rank",
    "complaint_corpus", "enrich_dimension", "roi_simulation", "semantic_search",
])
def test_no_cross_join(spark, sf_dir, key):
    plan = plan_of(QUERIES[key](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_numeric_queries_read_only_their_columns(spark, sf_dir):
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", plan_of(sk.sk_threshold(A.scored_lines(spark, sf_dir)))).group(1)
    assert schema == "struct<l_quantity:double,l_discount:double,l_tax:double>"


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(A.parts(spark, sf_dir).filter("category = 'ECONOMY'").select("product_id"))
    assert "EqualTo(p_type,ECONOMY)" in plan


def test_text_is_tokenised_once_per_scan(spark, sf_dir):
    """Filters on derived columns must not repeat the tokenisation."""
    rows = aspects.drop_outliers(common.labelled(spark, sf_dir)).filter("is_silent_killer AND sentiment_score < 0")
    plan = plan_of(rows.select("review_id", "topic_label", "emo_anger"))
    main = plan.split("Subquery")[0] + plan.split("+- Generate")[-1]
    assert main.count("split(lower(") == 1


def test_percentile_counts_are_exchanged_once(spark, sf_dir):
    df = sk.sk_threshold(common.scored(spark, sf_dir))
    df.collect()
    plan = plan_of(df).split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 1
    assert plan.count("split(lower(") == 1


def test_top_k_prunes_before_the_shuffle(spark, sf_dir):
    from quietstar.operators import ranking

    plan = plan_of(ranking.top_per_group(A.scored_lines(spark, sf_dir), ["product_id"], [F.desc("prob_negative")], 3))
    assert plan.count("WindowGroupLimit") == 2
