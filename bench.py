"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
Every query is planned and run in full into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import re
import time

from kerbside.catalogue.queries import QUERIES
from kerbside.session import build_session

HEADLINE = [
    "clean_traffic", "quality_counts", "normalize_bulk", "dedupe_keep_last", "normalize_road_reference", "explode_occurrences",
    "road_statistics", "eligible_roads", "gap_histogram", "gap_context", "capped_per_road", "systematic_sample",
    "traffic_lags", "traffic_targets", "weather_features", "road_features", "public_holiday_features", "time_features",
    "event_radius_pairs", "active_interval_count", "event_features",
    "build_traffic_features", "build_training_features", "build_prediction_features", "make_training_dataset",
    "temporal_split", "persistence_baseline", "quality_gate",
    "latest_observation_per_road", "latest_predictions", "road_history", "prediction_coverage",
    "upsert_traffic", "upsert_predictions", "bulk_import", "incremental_ingest", "stream_bulk_inbox",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("kerbside-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("latest_traffic_timestamp")  # starts the JVM's workers
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else sf_dir, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
