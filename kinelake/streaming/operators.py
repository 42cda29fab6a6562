"""Stream operators. All but the stateful ones work on tables and streams alike."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinelake.functions import scalars as X
from kinelake.operators.filters import (
    MIN_FPS,
    ONE_EURO_BETA,
    ONE_EURO_DERIVATIVE_CUTOFF,
    ONE_EURO_MIN_STRENGTH,
    one_euro_alpha,
)
from kinelake.operators.projections import STALE_AFTER_FLOOR, check_source, validate_samples
from kinelake.operators.windows import PAUSE_AFTER


def event_time(ns: str = "captured_at_ns") -> Column:
    """Event time of a capture; watermarks need a zoned timestamp."""
    return F.timestamp_micros((F.col(ns) / 1000).cast("long"))


def tick_sample(stream: DataFrame, fps: float, columns: Sequence[str], lateness: str = "10 seconds") -> DataFrame:
    """The latest sample of each run in every tick of 1/fps seconds.

    As a stream, ticks older than the lateness leave the state. In update mode a tick that later micro-batches add to is sent
    again; ``latest_ticks`` keeps its last row.
    """
    micros = max(1, round(1e6 / fps))
    timed = stream.withColumn("event_time", event_time())
    timed = timed.withWatermark("event_time", lateness) if stream.isStreaming else timed
    tick = F.window("event_time", f"{micros} microseconds")
    body = F.struct(*columns)
    return (
        timed.groupBy("run_id", tick.alias("tick"))
        .agg(F.max_by(body, F.struct("captured_at_ns", "sequence")).alias("_s"), F.count(F.lit(1)).alias("polled"))
        .select("run_id", F.col("tick.start").alias("tick_start"), "polled", "_s.*")
    )


def latest_ticks(rows: DataFrame) -> DataFrame:
    """Of a tick's rows from several micro-batches (column ``batch_id``) the last."""
    others = [c for c in rows.columns if c not in ("run_id", "tick_start", "batch_id")]
    last = rows.groupBy("run_id", "tick_start").agg(F.max_by(F.struct(*others), "batch_id").alias("_t"))
    return last.select("run_id", "tick_start", "_t.*")


def drop_stale(
    stream: DataFrame, received_ns: Column, stale_after: float = 0.5, lateness: str = "10 seconds"
) -> DataFrame:
    """Samples older than the age limit on arrival are dropped; later state forgets what is older than the lateness."""
    limit = max(STALE_AFTER_FLOOR, stale_after)
    fresh = stream.where(X.age_seconds(F.col("captured_at_ns"), received_ns) <= limit)
    timed = fresh.withColumn("event_time", event_time())
    return timed.withWatermark("event_time", lateness) if stream.isStreaming else timed


def sync_pairs(
    samples: DataFrame, cameras: DataFrame, stale_after: float = 0.5, lateness: str = "10 seconds"
) -> DataFrame:
    """Stream-stream interval join: each sample with the camera frames at most ``stale_after`` older.

    The interval and the watermarks bound the state kept on both sides. ``latest_pairs`` picks one frame per camera; an empty
    frame takes part, as it hides the older ones behind it.
    """
    limit = max(STALE_AFTER_FLOOR, stale_after)
    left = samples.withColumn("sample_time", event_time())
    right = cameras.select(
        F.col("run_id").alias("camera_run"),
        "camera",
        F.col("empty").alias("camera_empty"),
        F.col("sequence").alias("camera_sequence"),
        F.col("captured_at_ns").alias("camera_at_ns"),
    ).withColumn("camera_time", event_time("camera_at_ns"))
    if samples.isStreaming:
        left = left.withWatermark("sample_time", lateness)
        right = right.withWatermark("camera_time", lateness)
    near = (
        (F.col("run_id") == F.col("camera_run"))
        & (F.col("camera_time") <= F.col("sample_time"))
        & (F.col("camera_time") >= F.col("sample_time") - F.expr(f"INTERVAL {limit!r} SECONDS"))
    )
    return left.join(right, near).drop("camera_run")


def latest_pairs(pairs: DataFrame, keys: Sequence[str] = ("run_id", "sequence", "captured_at_ns")) -> DataFrame:
    """The newest camera frame of each sample and camera; none where that frame is empty, however good older ones are."""
    newest = F.max(F.struct("camera_at_ns", "camera_sequence", "camera_empty")).alias("_n")
    stamp = F.struct(F.col("_n.camera_sequence").alias("sequence"), F.col("_n.camera_at_ns").alias("captured_at_ns"))
    return pairs.groupBy(*keys, "camera").agg(newest).where(~F.col("_n.camera_empty")).select(*keys, "camera", stamp.alias("stamp"))


def require_all_cameras(pairs: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Samples that have a frame of every expected camera, with those frames as a map."""
    latest = latest_pairs(pairs).where(F.col("camera").isin(*expected))
    entry = F.struct("camera", "stamp")
    # At most one entry per expected camera.
    return (
        latest.groupBy("run_id", "sequence", "captured_at_ns")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("cameras"))
        .where(F.size("cameras") == len(set(expected)))
    )


def latest_only(batch: DataFrame, batch_id: int, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """For a slow consumer: the newest frame of a micro-batch per run, and how many were passed over."""
    others = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(
        F.max_by(F.struct(*others), "sequence").alias("_f"), (F.count(F.lit(1)) - 1).alias("dropped")
    ).select(*keys, "_f.*", "dropped", F.lit(batch_id).cast("long").alias("batch_id"))


def publish_live(samples: DataFrame, source: str) -> DataFrame:
    """Live samples as wire rows; a message that is no sample becomes an error row and stops nothing."""
    name = check_source(source)
    values = F.transform("joint_names", lambda n: F.coalesce(F.element_at(F.col(name), n), F.lit(0.0)))
    body = F.struct(
        "sequence", "captured_at_ns", "joint_names", values.alias("positions"), F.lit(name).alias("source"), "units"
    )
    ok = F.col("error").isNull()
    return samples.select(
        "run_id", "sequence", F.when(ok, F.to_json(body)).alias("value"), F.col("error").alias("error")
    )


# --- stateful -----------------------------------------------------------------------------------------------------

# State of a run goes once event time has passed its last row by this much; rows as late as that are not applied any more.
LATENESS, IDLE_MS = "1 day", 24 * 3600 * 1000
STATE_TIME = "_state_time"


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn(STATE_TIME, event_time()).withWatermark(STATE_TIME, LATENESS)


def _keep(state: GroupState, value: tuple, last_ns: int) -> None:
    state.update(value)
    state.setTimeoutTimestamp(max(int(last_ns) // 1_000_000 + IDLE_MS, state.getCurrentWatermarkMs() + 1))


def _ordered(chunks: Iterator[pd.DataFrame], *names: str) -> tuple[list[np.ndarray], int]:
    """The named columns of a run's rows in the order of time and sequence, and the time of the last row.

    Plain arrays: a micro-batch holds few rows of very many runs, where frames made per run cost more than the work on them.
    """
    parts = list(chunks)
    at, sequence, *others = (
        parts[0][n].to_numpy() if len(parts) == 1 else np.concatenate([p[n].to_numpy() for p in parts])
        for n in ("captured_at_ns", "sequence", *names)
    )
    order = np.lexsort((sequence, at))
    return [sequence[order], *(o[order] for o in others)], at[order[-1]]


def number_frames(frames: DataFrame) -> DataFrame:
    """Running count of the frames of each run, across micro-batches."""

    def count(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done = state.get[0] if state.exists else 0
        (sequence, timestamp), last = _ordered(chunks, "timestamp")
        _keep(state, (done + len(sequence),), last)
        yield pd.DataFrame(
            {"run_id": key[0], "sequence": sequence, "frame_index": np.arange(done, done + len(sequence)), "timestamp": timestamp}
        )

    slim = _timed(frames.select("run_id", "sequence", "captured_at_ns", "timestamp"))
    kind = frames.schema["run_id"].dataType.simpleString()
    return slim.groupBy("run_id").applyInPandasWithState(
        count, f"run_id {kind}, sequence bigint, frame_index bigint, timestamp double", "done bigint", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def run_controller(inputs: DataFrame) -> DataFrame:
    """What happens to each tick of a run, with control events in the same stream.

    ``inputs``: ``run_id, captured_at_ns, sequence, error`` (ticks; NULL = fine) and ``event`` (pause, resume, stop,
    save, discard; NULL for ticks). Output: one row per tick or closing event with the run's counters so far. The state
    of a run is five numbers; a micro-batch's rows of one run are ordered by time before they are applied.
    """

    def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        captured, dropped, failures, paused, closed = state.get if state.exists else (0, 0, 0, False, False)
        rows, last = _ordered(chunks, "error", "event")
        out = []
        for sequence, error, event in zip(*rows):
            if isinstance(event, str):
                if event == "resume":
                    paused, failures = False, 0
                elif event == "pause":
                    paused = True
                else:
                    closed = True
                    captured = 0 if event == "discard" else captured
                    out.append((sequence, event, captured, dropped, failures, paused))
                continue
            if closed or paused:
                outcome = "skipped"
            elif isinstance(error, str):
                dropped, failures, outcome = dropped + 1, failures + 1, "dropped"
                paused = paused or failures >= PAUSE_AFTER
            else:
                captured, failures, outcome = captured + 1, 0, "captured"
            out.append((sequence, outcome, captured, dropped, failures, paused))
        _keep(state, (captured, dropped, failures, paused, closed), last)
        table = pd.DataFrame(out, columns=["sequence", "outcome", "captured", "dropped", "failures", "paused"])
        table.insert(0, "run_id", key[0])
        yield table

    kind = inputs.schema["run_id"].dataType.simpleString()
    slim = _timed(inputs.select("run_id", "captured_at_ns", "sequence", "error", "event"))
    return slim.groupBy("run_id").applyInPandasWithState(
        follow,
        f"run_id {kind}, sequence bigint, outcome string, captured bigint, dropped bigint, failures bigint, paused boolean",
        "captured bigint, dropped bigint, failures bigint, paused boolean, closed boolean",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def one_euro_stream(samples: DataFrame, channel: str = "action", strength: float = 1.0, fps: float = 30.0) -> DataFrame:
    """Causal smoothing of live samples; the state of a run is the last value and speed of each joint."""
    dt = 1.0 / max(MIN_FPS, fps)
    slow = 1.0 / max(ONE_EURO_MIN_STRENGTH, strength)
    gain = float(one_euro_alpha(ONE_EURO_DERIVATIVE_CUTOFF, dt))

    def alpha(cutoff: float) -> float:
        return 1.0 / (1.0 + 1.0 / (2.0 * math.pi * max(cutoff, 1e-6)) / dt)

    def smooth(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (sequence, joints, values), latest = _ordered(chunks, "joint", "value")
        known = {j: (x, v) for j, x, v in zip(*state.get)} if state.exists else {}
        out = np.empty(len(values))
        for i, (joint, value) in enumerate(zip(joints, values.tolist())):
            speed = 0.0
            if joint in known:
                last, speed = known[joint]
                speed = gain * (value - last) / dt + (1.0 - gain) * speed
                blend = alpha(slow + ONE_EURO_BETA * abs(speed))
                value = blend * value + (1.0 - blend) * last
            out[i] = value
            known[joint] = (value, speed)
        _keep(state, (list(known), [x for x, _ in known.values()], [v for _, v in known.values()]), latest)
        yield pd.DataFrame({"run_id": key[0], "joint": joints, "sequence": sequence, "smoothed": out})

    timed = _timed(samples.select("run_id", "captured_at_ns", "sequence", channel))
    long = timed.select("run_id", "captured_at_ns", "sequence", STATE_TIME, F.explode(channel).alias("joint", "value"))
    kind = samples.schema["run_id"].dataType.simpleString()
    # All joints of a run are one group: its rows leave the run's tasks once, not once per joint.
    return long.groupBy("run_id").applyInPandasWithState(
        smooth, f"run_id {kind}, joint string, sequence bigint, smoothed double",
        "joints array<string>, last array<double>, speed array<double>", "append", GroupStateTimeout.EventTimeTimeout,
    )


# --- recorder -----------------------------------------------------------------------------------------------------


def record(
    samples: DataFrame, cameras: DataFrame, now_ns: Column, sink: str, checkpoint: str, stale_after: float = 0.5,
    require_armed: bool = True, lateness: str = "10 seconds",
):
    """Start recording: valid samples with their candidate camera frames go to ``sink``.

    The checkpoint makes a restart continue where the last batch ended. Returns a started writer for the caller to
    trigger and stop; ``recorded_frames`` reads what has been recorded.
    """
    valid = validate_samples(samples, now_ns, stale_after, require_armed).where(F.col("reason").isNull()).drop("reason")
    pairs = sync_pairs(valid, cameras, stale_after, lateness).drop("sample_time", "camera_time")
    return pairs.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)


def recorded_frames(pairs: DataFrame, expected: Sequence[str], fps: Column) -> DataFrame:
    """Recorded samples that have all cameras, numbered along their run."""
    from kinelake.operators.windows import assign_timeline

    return assign_timeline(require_all_cameras(pairs, expected), fps)
