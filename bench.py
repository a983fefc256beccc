"""Prints one JSON line with the seconds of the headline queries at $BENCH_SF_DIR."""

import json
import os
import time

from pyspark.sql import SparkSession

from deltaweave.queries import QUERIES

HEADLINE = [
    "keyed_diff", "cascade_groups", "delta_summary", "classify_elements", "element_attributes", "stable_ids", "run_clusters", "revision_pairs", "precheck", "registration_recover", "element_assignment",
    "delta_confidence", "residue", "raster_regions", "bm25_topk", "answer_gate", "prf_scores", "calibration_bands", "collapse_notes", "trace_tree", "markdown_report",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["keyed_diff"](spark, path).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
