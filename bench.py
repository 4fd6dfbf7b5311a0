"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of local threads. Every query is written to the
no-op sink, so all rows and columns are computed. One short query warms the session up first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ringsight.plans import REGISTRY
from ringsight.session import build_session, clear_stages

HEADLINE = [
    "gap_declaration",
    "late_drop",
    "arrival_health",
    "reorder_window",
    "interval_sampler",
    "ramp_trigger",
    "slot_status",
    "severity_score",
    "column_scatter",
    "neighbour_dissimilarity",
    "best_offset",
    "loop_lock",
    "reference_match",
    "interpolated_position",
    "population_score",
    "history_state",
    "stacked_plate_score",
    "persistent_list",
    "new_drop_alerts",
    "splay_alerts",
    "hidden_runs",
    "gap_rule",
    "density_rule",
    "stable_flags",
    "keyed_upsert",
    "alert_page",
    "window_report",
    "minute_rollup",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark__sql__shuffle__partitions": cpus,
            "spark__ui__enabled": "false",
            "spark__ui__showConsoleProgress": "false",
            "spark__driver__memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: REGISTRY[name].plan(spark, sf).write.format("noop").mode("overwrite").save()
    run("slot_status")
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - started, 3)
    frames = spark.read.parquet(f"{sf}/events.parquet").count()
    per_frame = ["gap_declaration", "ramp_trigger", "slot_status", "severity_score", "population_score", "history_state"]
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "frames_per_sec": {n: round(frames / times[n]) for n in per_frame},
                "sf": os.path.basename(sf.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    clear_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()
