"""Time the headline queries once each and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from noticemill.plans import catalogue  # noqa: E402

HEADLINE = [
    "order_status_summary",
    "order_latest_amendment",
    "document_mirrors",
    "page_mirrors",
    "part_components",
    "order_capped_candidates",
    "order_fair_selection",
    "order_interleave",
    "part_search",
    "part_closing_order",
    "part_facets",
    "line_source_funnel",
    "nation_diagnostics",
    "event_latest_records",
    "order_feed_items",
    "order_feed_changes",
    "page_link_counts",
    "order_dates_parsed",
    "order_labelled_deadlines",
    "document_identity_keys",
    "document_topics",
    "document_source_funnel",
    "medical_taxonomy_scan",
    "benchmark_passages",
    "supplier_offices",
    "document_clause_hits",
    "conversation_clauses",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("noticemill-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.time()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "total seconds over the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
