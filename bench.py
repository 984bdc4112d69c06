"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evloom.plans import load  # noqa: E402
from evloom.session import build_session  # noqa: E402

HEADLINE = ["effective_status", "descriptive_groups", "comparable_groups", "normalized_measurements", "canonical_dois", "status_by_doi",
            "citation_records", "publication_merge", "notice_targets", "verified_measurements", "excerpt_containment", "reference_alignment",
            "mean_differences", "pooled_estimates", "invalidated_documents", "flat_rows", "digitized_points", "usage_costs"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.sql.files.maxPartitionBytes": "8m", "spark.sql.files.openCostInBytes": "1m"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
