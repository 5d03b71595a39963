"""Time the headline queries: one warm-up, then the median of three full runs into a noop sink."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from registry.queries import OPERATORS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ONLY = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

# One query per check; variants and one-row arithmetic on their results are left out.
HEADLINE = [
    "coverage_overall", "coverage_by_source", "coverage_published_total", "coverage_domain_universe",
    "domain_status_distribution", "email_format_distribution", "invalid_email_examples", "company_valid_format",
    "duplicate_summary", "unique_duplicate_count", "duplicate_top", "duplicate_buckets", "domain_match_by_country",
    "domain_match_rollup", "domain_match_company_review", "domain_match_emails", "domain_root_match",
    "domain_mismatch_examples", "blocked_summary", "deliverability_distribution", "email_volume_by_country",
    "email_volume_examples", "priority_top_emails", "release_metrics", "composite_score", "upsert_metrics",
    "release_change",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS if CPUS.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    OPERATORS[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    times = {}
    for name in ONLY or HEADLINE:
        seconds(spark, name)
        times[name] = round(statistics.median(seconds(spark, name) for _ in range(RUNS)), 4)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, each the median of its runs after a warm-up",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cores": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
