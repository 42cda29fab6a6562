"""Stateful synchronisation of streams equals the batch one, whatever the micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import joins as J
from kinelake.streaming import sync as Y

NAMES = ["front", "wrist"]
SECOND = 1_000_000_000


@pytest.fixture(scope="module")
def rows():
    """(side, run, at, sequence, camera, empty) in the order of arrival: time, up to two seconds late."""
    rng = np.random.default_rng(7)
    out = []
    for run in (1, 2):
        for i in range(120):
            out.append((Y.SAMPLE, run, int(rng.integers(1, 600)) * SECOND // 10, i, None, None))
        for i in range(160):
            camera = ["front", "wrist", "other"][int(rng.integers(3))]
            out.append((Y.CAMERA, run, int(rng.integers(1, 600)) * SECOND // 10, i, camera, bool(rng.random() < 0.1)))
    out += [(Y.SAMPLE, None, SECOND, 0, None, None), (Y.SAMPLE, 1, None, 999, None, None), (Y.CAMERA, 1, SECOND, 7, None, False)]
    return sorted(out, key=lambda r: (r[2] or 0) + int(rng.integers(0, 2 * SECOND)))


SCHEMA = "side int, run_id long, captured_at_ns long, sequence long, camera string, empty boolean"


def run(spark, folder, rows, parts, ended=True):
    folder.mkdir()
    edges = np.linspace(0, len(rows), parts + 1).astype(int)
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        part = rows[a:b] + ([(Y.END, r, 10**12, None, None, None) for r in (1, 2)] if ended and i == parts - 1 else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    samples, cameras, ends = (source.where(F.col("side") == s).drop("side") for s in (Y.SAMPLE, Y.CAMERA, Y.END))
    out = Y.sync_stateful(samples, cameras, NAMES, 0.5, "3 seconds", ends)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def plain(df, *more):
    stamp = [F.col("cameras")[n][k] for n in NAMES for k in ("sequence", "captured_at_ns")]
    return sorted(tuple(r) for r in df.select("run_id", "captured_at_ns", "sequence", *stamp, F.coalesce("reason", F.lit("")), *more).collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_streams_equal_tables(spark, rows, tmp_path, parts):
    whole = spark.createDataFrame([r for r in rows if r[1] is not None and r[2] is not None], SCHEMA)
    samples, cameras = whole.where("side = 1"), whole.where("side = 0")
    wanted = J.sync_streams(samples, cameras, NAMES, 0.5)
    found = run(spark, tmp_path / "s", rows, parts)
    # A late, empty or missing camera reads the same; ties of a camera go to the larger sequence in both.
    assert [r[:3] + r[-1:] for r in plain(found)] == [r[:3] + r[-1:] for r in plain(wanted)]
    assert plain(found) == plain(wanted)
    kept = sorted((r[0], r[1], r[2], r[-1]) for r in plain(found.where("reason is null"), "frame_index"))
    assert [r[3] for r in kept] == [i for k in (1, 2) for i in range(sum(r[0] == k for r in kept))] and len(kept) > 10
    assert found.where("reason is not null and frame_index is not null").count() == 0


def test_samples_wait_until_the_watermark_has_passed(spark, rows, tmp_path):
    found = run(spark, tmp_path / "s", rows, 4, ended=False)
    last = max(r[2] for r in rows if r[2])
    times = [r.captured_at_ns for r in found.collect()]
    assert times and max(times) <= last - 3 * SECOND
    whole = {(r[1], r[3]) for r in rows if r[0] == Y.SAMPLE and r[1] and r[2] and r[2] <= last - 3 * SECOND}
    assert {(r.run_id, r.sequence) for r in found.collect()} == whole


def test_runs_share_buckets_of_state(spark, tmp_path):
    """State has one group per bucket however many runs there are; runs of a bucket do not mix, and idle ones are forgotten."""
    rows = []
    for r in range(60):
        rows += [(Y.CAMERA, r, (10 + r) * SECOND, 1, "front", False), (Y.CAMERA, r, (10 + r) * SECOND, 1, "wrist", r % 5 == 0)]
        rows += [(Y.SAMPLE, r, (10 + r) * SECOND + i, i, None, None) for i in (1, 2)]
    # A row without a number keeps large numbers beside it exact; a day later all but the last run have gone.
    rows += [(Y.SAMPLE, 0, 11 * SECOND, 2**60 + 1, None, None), (Y.SAMPLE, 0, 11 * SECOND + 1, None, None, None)]
    rows += [(Y.SAMPLE, 99, 3 * 86_400 * SECOND, 1, None, None)]
    spark.createDataFrame(rows[:-1], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame(rows[-1:], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    samples, cameras = (source.where(F.col("side") == s).drop("side") for s in (Y.SAMPLE, Y.CAMERA))
    out = Y.sync_stateful(samples, cameras, NAMES, 5.0, "3 seconds", buckets=4)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 1 < max(held) <= 4 and held[-1] == 1
    found = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.run_id, r.frame_index) for r in found if r.run_id % 5) == [(r, i) for r in range(60) if r % 5 for i in (0, 1)]
    assert all(r.frame_index is None for r in found if r.run_id % 5 == 0) and len(found) == 122
    assert {r.sequence for r in found if r.run_id == 0} == {1, 2, 2**60 + 1, None}
