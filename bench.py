"""Time the headline queries; prints one JSON line.

Every query is written to Spark's ``noop`` sink, so all rows are computed and none reach the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quietstar import catalog  # noqa: E402
from quietstar.session import local_session  # noqa: E402

HEADLINE = [
    "silent_killer_diagnosis", "sk_threshold", "sk_threshold_by_product", "revenue_at_risk", "diagnostic_report",
    "sentiment_lexicon", "detect_language", "translate_selective", "aspect_stats", "emotion_heatmap", "class_tfidf",
    "roi_simulation", "executive_summary", "temporal_trend", "monthly_sk_join", "monthly_anomalies", "sentiment_forecast",
    "forecast_bootstrap_ci", "discover_products", "competitor_benchmark", "product_identity", "semantic_search",
    "copilot_insight", "complaint_corpus", "complaint_summary", "stratified_sample", "data_quality_report", "auroc_rank",
    "leakage_audit", "stream_product_counts", "stream_flagging",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
