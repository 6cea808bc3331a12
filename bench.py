"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from draftline.catalog import QUERIES
from draftline.sources.match_view import match_view

HEADLINE = (
    "curated_sample",
    "curated_all",
    "keep_latest_matches",
    "hash_sample",
    "null_profile",
    "column_inventory",
    "metadata_record",
    "quality_checks",
    "pick_frequency",
    "side_frequency",
    "split_boundaries",
    "split_boundaries_shipdate",
    "split_plan",
    "split_summary",
    "vocabulary",
    "unseen_hero_summary",
    "encoded_long",
    "sparsity",
    "feature_checks",
    "roc_auc",
    "roc_points",
    "line_metrics",
    "prior_metrics",
    "baseline_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("draftline-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="draftline-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    started = time.perf_counter()
    match_view(spark, folder).count()  # raw table, written once
    seconds = {"prepare_raw": round(time.perf_counter() - started, 3)}
    started = time.perf_counter()
    QUERIES["missing_cells_curated"](spark, folder).collect()  # curated table, written once
    seconds["prepare_curated"] = round(time.perf_counter() - started, 3)
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()

    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
