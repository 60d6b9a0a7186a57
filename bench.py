"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS    cores of the local session (default 8)
BENCH_REPEATS timed runs per query after one warm-up; the median counts (default 1)
BENCH_QUERIES names separated by commas, or "all" (default: the headline list)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from riskloom.catalog import QUERIES
from riskloom.session import local_session

HEADLINE = [
    "raw_transactions", "fraud_extract", "fraud_features", "high_risk_extract", "churn_features", "matured_feedback",
    "actual_vs_prediction", "fill_missing_predictions", "atm_lags", "weekend_moving_avg", "prev_weekday_amount",
    "atm_features", "balance_replay", "status_merge", "batch_run_summary", "daily_atm_history", "allocate_ids",
    "baseline_deciles_pct", "baseline_deciles_open", "baseline_mixed", "psi_percent", "psi_fraction", "drift_report",
    "drift_decision", "monitor_error", "residual_interval", "weighted_confusion", "roc_auc", "ks_statistic",
    "optimal_threshold", "feedback_monitor", "undersample", "stratified_split", "temporal_split", "time_series_folds",
    "robust_scale", "standard_scale", "label_encode", "champion_timeline", "registry_violations", "append_roundtrip",
    "smote_oversample", "isolation_forest_score",
]


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(repeats)), 3)
        print(name, times[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rsplit("sf", 1)[-1],
                "cpus": cores,
                "repeats": repeats,
                "settings": {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")},
            }
        )
    )


if __name__ == "__main__":
    main()
