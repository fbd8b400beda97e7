"""Headline queries, timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from watchtrail.plans.catalog import CATALOG
from watchtrail.session import checkpoint_dir, prepare

HEADLINE = (
    "feature_vector",
    "calls_last",
    "unique_services_last",
    "score",
    "forest_decision",
    "score_envelopes",
    "batch_summary",
    "hourly_risk_counts",
    "scoring_metrics",
    "latency_stats",
    "latency_rollup",
    "external_ip_ranges",
    "stratified_split",
    "calibrate_threshold_lineitem",
    "roc_auc_lineitem",
    "average_precision_lineitem",
    "explain",
    "recommend_actions",
    "insert_incidents",
    "find_related",
    "find_related_all",
    "investigate_all",
    "score_dataset",
    "fit_forest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = prepare(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    checkpoint_dir(spark)
    # One small query first, so that the first timed one does not pay for the JVM's start.
    CATALOG["calendar_features"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    report = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
