"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES (comma-separated) a choice of queries, BENCH_RUNS how
often each is run (the median counts). A run is timed from building the plan to the last row. Before the
first, one query warms up scans, shuffles and Python workers; its time does not count.
"""

import json
import os
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "cluster_features", "cluster_priority_topk", "event_priority_queue", "gate_flags", "admission_errors", "exact_dedupe",
    "feed_events", "novelty", "question_dedupe", "capped_story_dedupe", "vector_dedupe", "dbscan",
    "dashboard_queue", "repair_queue", "topic_rollup", "windowed_velocity", "token_fingerprint", "question_contract",
    "extraction_prompts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cpus))))
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINTS") or tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from omenflow import catalog

    catalog.NAMED["token_fingerprint"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.time()
            catalog.NAMED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        times[name] = round(median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
