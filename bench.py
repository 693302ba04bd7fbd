"""Headline queries at one scale, one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated names, or "all"
BENCH_RUNS     timed runs per query after one warm run (default 3)
"""

import json
import os
import resource
import statistics
import sys
import time

from gridspark.session import build_session
from gridspark.workload import load

HEADLINE = [
    # Observation to cloud-cover fusion.
    "k0_cloudy_share_per_hour", "k1_clear_sky_composites", "k2_cloud_cover", "k3_seam_balance", "k4_deep_convection",
    "k5_storm_steering", "k6_model_packing",
    # Pyramid build and audit.
    "d2_full_pyramid", "k10_day_pyramid", "k12_retiled_layers", "a15_pyramid_index", "c15_pyramid_gaps",
    # Requests: merge, top-k, service order, fallback.
    "d13_merged_requests", "f1_top_requests", "f2_service_order", "c14_parent_fallback", "g4_eviction_plan",
    # Index, as-of and regrid kernels.
    "a1_message_ranges", "c2_asof_elements", "c3_regrid_bilinear", "c11_area_overlap", "d11_scene_summary",
    "e2_polar_lowpass", "e7_max_filter", "e8_gaussian_feather", "e9_filled_holes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    registry = load()
    names = list(registry) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for run in range(runs + 1):
            start = time.perf_counter()
            registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
        "peak_python_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
