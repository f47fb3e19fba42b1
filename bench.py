"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Every query is evaluated completely into the no-op sink; one warm-up query is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from opswatch.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "run_projection",
    "run_counts",
    "runs_filtered",
    "runs_hydrated",
    "runs_page_hydrated",
    "run_metrics",
    "timeline",
    "reconcile_runs",
    "occurrence_ledger",
    "schedule_summary",
    "schedule_diff",
    "stuck_runs",
    "duplicate_execution",
    "new_annotations",
    "recovery_plan",
    "component_report",
    "metric_samples",
    "alerts_opened",
    "alerts_resolved",
    "event_correlation",
    "feed_envelopes",
    "activity_histogram",
    "transitions",
    "coalesced",
    "rate_limited",
    "stale_guard",
    "keyset_page",
    "worker_details",
    "endpoint_summary",
    "pii_findings",
    "artifact_scan",
    "json_scan",
    "submission_scan",
    "finding_records",
    "pii_masked",
]


def evaluate(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("opswatch-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    evaluate(QUERIES["pii_findings"](spark, sf_dir))
    evaluate(QUERIES["run_projection"](spark, sf_dir))
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        evaluate(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
