"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
Each query runs once to warm up; the best of three further runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from querysuite.catalog import QUERIES

HEADLINE = (
    "supported_files",
    "explode_lines",
    "rule_match",
    "heur_secret",
    "scan_all",
    "scan_documents",
    "dedupe_findings",
    "min_severity",
    "ordered_findings",
    "severity_summary",
    "severity_by_file",
    "report_by_file",
    "report_json",
    "report_text",
    "scan_status",
    "last_run_report",
    "current_findings",
)


def seconds(query, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        seconds(QUERIES[name], spark, sf_dir)
        times[name] = round(min(seconds(QUERIES[name], spark, sf_dir) for _ in range(3)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    lines = QUERIES["explode_lines"](spark, sf_dir).count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "lines_per_sec": {name: round(lines / times[name]) for name in ("explode_lines", "rule_match", "scan_all")},
            }
        )
    )


if __name__ == "__main__":
    main()
