"""Times the headline queries; prints one JSON line. BENCH_SF_DIR: the tables' folder; BENCH_CPUS: threads of the local session."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
QUERIES = [
    "currency_mismatch_report", "extra_whitespace", "sentences", "clean_web_text", "issues_by_type", "layout_constants", "pdf_ready", "header_footer",
    "noise_antijoin", "join_hyphen_lines", "job_latest_state", "dom_stability", "html_content_text", "missing_paragraph_exact", "fidelity_report",
]
RUNS, LONG = 3, 60.0  # a query that takes so many seconds at first is not repeated


def main() -> None:
    from veridoc.plans import catalog

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in QUERIES:
        times = []
        for _ in range(RUNS + 1):  # the first run warms up
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            if times[0] > LONG:
                break
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale, "cpus": cpus, "spark": spark.version, "shuffle_partitions": cpus}))
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
