"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidewatch.operators.features import gate_posts  # noqa: E402
from tidewatch.plans import QUERIES  # noqa: E402
from tidewatch.plans.sql import INTERCEPT  # noqa: E402
from tidewatch.plans.tables import Tables  # noqa: E402
from tidewatch.session import build_session, settle  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "ranked_incidents", "cluster_window", "neighbour_counts", "summarise_clusters", "cluster_density", "digest",
    "incident_sources", "dedupe_report", "stratified_split_exact", "build_vocabulary", "geocode", "lookup_fuzzy_ratio",
    "extract_places", "auc", "threshold_sweep", "label_window_counts",
)


def run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session("bench", cores=CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, FOLDER)
    seconds: dict[str, float] = {}

    # The gate on whole texts and on their lines, which are about as long as a post.
    weights = tables.weights
    long_posts = settle(tables.documents.select("doc_id", "text"))
    lines = long_posts.select("doc_id", F.explode(F.split("text", "\n")).alias("text")).filter(F.length("text") > 5)
    short_posts = settle(lines.repartition(int(CPUS), "text"))
    rates = {}
    for name, posts in (("gate_texts", long_posts), ("gate_lines", short_posts)):
        run(gate_posts(posts, weights, INTERCEPT))  # warm up: the gate is a long-running job
        seconds[name] = run(gate_posts(posts, weights, INTERCEPT))
        rates[f"{name}_per_sec"] = round(posts.count() / seconds[name], 1)

    for name in HEADLINES:
        start = time.perf_counter()
        run(QUERIES[name](spark, FOLDER))
        seconds[name] = time.perf_counter() - start
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
                "cores": int(CPUS),
                "posts_per_sec": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
