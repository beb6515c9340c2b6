"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "kinematic_series", "run_segments", "track_summary", "kinematic_series_calibrated", "pixel_to_world", "densify",
    "compensate_shake", "predict_next", "representative_points", "fit_line_cumulative", "score_models_visible",
    "track_metrics", "pose_metrics", "regression_items", "video_index", "nearest_in_time",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from motionloom.plans import load_queries
    from motionloom.session import build_session

    spark = build_session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_queries()[0]
    queries["track_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM paths
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
