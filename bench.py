"""Benchmark: run the headline reports at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line with per-query seconds.

Every query is executed in full through the ``noop`` sink (all partitions
computed, nothing collected to the driver), including building its DataFrame.
One warm-up pass runs first so the timings measure query work, not JVM start-up
and code generation; then each report runs ``$BENCH_REPEAT`` times (default 3)
and the best time is reported (the median is printed as well), because the
host's timings vary by tens of percent between runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kpiloom.plans.reports import run_report  # noqa: E402
from kpiloom.session import build_session  # noqa: E402

HEADLINE = [
    "revenue_daily", "revenue_daily_completed", "revenue_daily_range", "revenue_last_7",
    "funnel_users", "funnel_event_set", "funnel_rates",
    "retention_weekly", "retention_unbounded", "retention_pivot",
    "features_conversion", "ab_group", "ab_metrics", "ab_experiment", "ab_test_invalid",
    "dq_report",
]
ML = ["ml_leaderboard", "ml_shap"]


def run(spark, name, sf_dir):
    t0 = time.perf_counter()
    run_report(spark, name, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    with_ml = os.environ.get("BENCH_ML", "1") != "0"
    spark = build_session(f"local[{cpus}]", app_name="kpiloom-bench", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "8g"})
    for name in HEADLINE:                      # warm-up
        run(spark, name, sf_dir)
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    samples = {name: [] for name in HEADLINE}
    for _ in range(repeat):
        for name in HEADLINE:
            samples[name].append(run(spark, name, sf_dir))
    times = {name: round(min(v), 3) for name, v in samples.items()}
    medians = {name: round(statistics.median(v), 3) for name, v in samples.items()}
    if with_ml:
        for name in ML:                        # training runs once; ml_shap reuses it
            times[name] = round(run(spark, name, sf_dir), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "kpi_seconds": round(sum(times[n] for n in HEADLINE), 3),
        "kpi_seconds_median": round(sum(medians.values()), 3),
        "repeat": repeat,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
