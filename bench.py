"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (comma-separated names).
Every query is run to its end into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from kinelake.operators import aggregates as A  # noqa: E402
from kinelake.operators import analysis as N  # noqa: E402
from kinelake.operators import evaluate as E  # noqa: E402
from kinelake.operators import filters as S  # noqa: E402
from kinelake.operators import joins as J  # noqa: E402
from kinelake.operators import paths as G  # noqa: E402
from kinelake.operators import windows as W  # noqa: E402
from kinelake.operators.blocks import exact_quantiles  # noqa: E402
from kinelake.plans import QUERIES  # noqa: E402
from kinelake.plans.evaluation import RULE  # noqa: E402
from kinelake.plans.fixtures import Tables  # noqa: E402
from kinelake.session import build_session  # noqa: E402
from kinelake.sources import export as X  # noqa: E402

CHANNELS = ("leader", "observation", "action")


def lines_episodes(t):
    return A.full_episodes(t.frames_lines).select(
        "dataset_id", "episode_index", F.array(*[F.lit(j) for j in ("base", "lift", "wrist", "gripper")]).alias("joint_names"),
        F.lit("pick").alias("task"),
    )


BENCH = {
    # The two frame tables are written here and scanned by what follows.
    "ingest_frames_lines": lambda t: t.frames_lines.groupBy().count(),
    "ingest_frames_events": lambda t: t.frames_events.groupBy().count(),
    "J1_sync_streams": lambda t: QUERIES["J1_sync_streams"](t.spark, t.root),
    "A4_feature_stats": lambda t: A.feature_stats(t.frames_lines, "observation_state"),
    "A11_jerk_rms": lambda t: A.jerk_rms(t.frames_lines, CHANNELS),
    "A15_percentiles": lambda t: exact_quantiles(
        t.frames_lines.select("dataset_id", "episode_index", F.get("action", F.lit(0)).cast("double").alias("v")),
        ["dataset_id", "episode_index"], "v", {"p1": 0.01, "p60": 0.6, "p99": 0.99},
    ),
    "F1_moving_average": lambda t: S.moving_average(t.frames_lines, 1.0, CHANNELS),
    "F2_gaussian": lambda t: S.gaussian(t.frames_lines, 1.0, CHANNELS),
    "F3_savgol": lambda t: S.savgol(t.frames_lines, 1.0, CHANNELS),
    "F4_spline": lambda t: S.spline(t.frames_lines, 1.0, CHANNELS),
    "F5_one_euro": lambda t: S.one_euro_filter(t.frames_lines, 1.0, 30.0, CHANNELS),
    "F9_sanitize": lambda t: G.sanitize(A.long_form(t.frames_lines, ("action",))),
    "W4_arm_velocity": lambda t: W.arm_velocity(t.frames_lines, F.lit(3)),
    "W6_runs": lambda t: W.runs(
        t.frames_lines.withColumn("m", F.get("observation_state", F.lit(3)) != F.get("action", F.lit(3))), "m"
    ),
    "E1_otsu": lambda t: N.otsu(t.frames_lines),
    "E14_evaluate_lines": lambda t: E.evaluate(t.frames_lines, lines_episodes(t), RULE),
    "E14_evaluate_events": lambda t: QUERIES["E14_evaluate"](t.spark, t.root),
    "V_validation_report": lambda t: QUERIES["V_validation_report"](t.spark, t.root),
    "S8_lerobot_frames": lambda t: X.lerobot_frames(t.frames_lines),
    "S11_hub_frames": lambda t: QUERIES["S11_hub_frames"](t.spark, t.root),
    "S16_to_wire": lambda t: QUERIES["S16_to_wire"](t.spark, t.root),
    "J5_replay_deliveries": lambda t: QUERIES["J5_replay_deliveries"](t.spark, t.root),
    "J6_retarget": lambda t: QUERIES["J6_retarget"](t.spark, t.root),
    "T5_run_controller": lambda t: QUERIES["T5_run_controller"](t.spark, t.root),
}


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": os.environ.get("BENCH_PARTITIONS", cpus),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy(F.col("id") % 7).count().collect()  # start the executors before the clock
    tables, seconds = Tables(spark, root), {}
    for name, plan in BENCH.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        plan(tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(root).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
