"""Benchmark the headline queries.

Runs each query in ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line.
Every query is executed in full through the ``noop`` sink (no driver
collect), after an untimed JVM warm-up on synthetic rows.  ``land_tables``
is the one-off cost of landing the raw, staged and roll-up layers that the
queries then read.  ``BENCH_QUERIES`` (comma list) restricts the set;
``BENCH_EVENT_LOG_DIR`` writes Spark's event log there for stage timings.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shiftlens.plans import catalog  # noqa: E402
from shiftlens.plans.catalog import REGISTRY  # noqa: E402
from shiftlens.session import get_spark  # noqa: E402

HEADLINE = [
    "dq_summary", "stg_trial_events", "mart_worker_adoption", "org_features", "conversion_overview",
    "worker_headline", "activity_uplift", "archetypes", "adoption_funnel", "depth_summary",
    "worker_timing", "handoff_gap", "handoff_buckets", "adoption_curve", "hist_total_events",
    "boxplot_stats", "mann_whitney_metrics", "roc_auc_score_table", "kaplan_meier", "cv_folds",
    "mart_trial_goals", "mart_trial_activation", "day14_outreach", "onboarding_nudge",
    "stream_onboarding_nudge", "rf_cv_auc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    event_log = os.environ.get("BENCH_EVENT_LOG_DIR")
    if event_log:
        # Stage and task times for later reading, written to a scratch folder.
        os.makedirs(event_log, exist_ok=True)
        os.environ["PYSPARK_SUBMIT_ARGS"] = (f"--conf spark.eventLog.enabled=true "
                                             f"--conf spark.eventLog.dir=file://{event_log} pyspark-shell")
    spark = get_spark(f"local[{cpus}]", app="shiftlens-bench", shuffle_partitions=int(cpus))
    # JVM warm-up on synthetic rows only: the landing of the staged tables is
    # timed below as its own entry, not hidden in the warm-up.
    spark.range(100_000).selectExpr("id % 97 AS k").groupBy("k").count().write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    t0 = time.perf_counter()
    for layer in (catalog.raw, catalog.stg, catalog.rollup):
        layer(spark, sf_dir)
    timings["land_tables"] = round(time.perf_counter() - t0, 3)
    for name in only or HEADLINE:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
