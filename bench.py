"""Times the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated) change the run."""

import json
import os
import time

from pyspark.sql import SparkSession

from hazeline import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "i4_event_metrics", "i7_average_precision", "i10_threshold_search", "i12_scenario_metrics", "i17_extreme_contingency", "j2_bootstrap_dates",
    "j8_mean_ensemble", "e1_asof_nearest", "e7_paired_intersection", "e8_pair_with_duplicates", "e12_idw_knn", "c1_canonicalize_units",
    "c3_sanitize_pm", "d9_derive_fields", "f1_sliding_window", "g1_fog_features_native", "g2_fog_features_full", "h1_month_tail_split",
    "h7_marginal_donor", "k1_feature_quality_scan", "k5_shared_covariate_diff",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few keys that a join expands would become one task
        .config("spark.sql.codegen.hugeMethodLimit", "8000")  # longer methods aren't compiled by HotSpot
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or [n for n in HEADLINE if n in queries]
    queries["i1_confusion_matrix"](spark, SF_DIR).count()  # starts the session
    seconds = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
