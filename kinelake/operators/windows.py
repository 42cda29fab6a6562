"""Ordered operators over captures, frames and episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions import vectors as V
from kinelake.operators.blocks import (
    EPISODE, RANGE, bounded_blocks, dense_index, frame_block, previous, running_total, with_neighbours,
)

# --- fixed values -------------------------------------------------------------------------------------------------
RATE_CAPTURES = 30
PAUSE_AFTER = 3
DAY_NS = 86_400_000_000_000
# ------------------------------------------------------------------------------------------------------------------


def time_block(ns: str, width: int = DAY_NS) -> Column:
    return F.floor(F.col(ns) / F.lit(width)).cast("long")


def placed_in_time(rows: DataFrame, out: str, width: int = DAY_NS) -> DataFrame:
    """Place of each row in its run by time and sequence; a burst of any size in a block of time is cut by rows."""
    keys, order = ["run_id"], ["captured_at_ns", "sequence"]
    held, block = bounded_blocks(rows, keys, order, time_block("captured_at_ns", width))
    return dense_index(held, keys, order, block, out).drop(RANGE)


def assign_timeline(captures: DataFrame, fps: Column, width: int = DAY_NS) -> DataFrame:
    """Frame index and nominal timestamp of each accepted capture of a run; drops and pauses leave no gap."""
    placed = placed_in_time(captures, "frame_index", width)
    return placed.withColumn("timestamp", (F.col("frame_index") / fps.cast("double")).cast("float"))


def episode_offsets(episodes: DataFrame) -> DataFrame:
    """First and one-past-last global frame number of each episode of a dataset."""
    totals = running_total(
        episodes, ["dataset_id"], ["episode_index"], frame_block(episodes, "episode_index"),
        F.col("frames").cast("long"), "dataset_to_index",
    )
    return totals.withColumn("dataset_from_index", F.col("dataset_to_index") - F.col("frames"))


def capture_rate(captures: DataFrame) -> DataFrame:
    """Captures per second over the last thirty captures, at every capture of a run."""
    def span(w):
        recent = w.rowsBetween(1 - RATE_CAPTURES, 0)
        elapsed = (F.max("captured_at_ns").over(recent) - F.min("captured_at_ns").over(recent)) / F.lit(1e9)
        n = F.count(F.lit(1)).over(recent)
        return F.when((n > 1) & (elapsed > 0), (n - 1) / elapsed).otherwise(F.lit(0.0))

    placed = placed_in_time(captures, "frame_index")
    return with_neighbours(placed, RATE_CAPTURES - 1, 0, {"capture_rate_hz": span}, ["run_id"])


def run_ids(df: DataFrame, mask: str, keys: Sequence[str] = EPISODE, index: str = "frame_index") -> DataFrame:
    """Number the maximal runs of true ``mask``; ``run`` is NULL outside them. ``index`` is dense."""
    begins = with_neighbours(
        df,
        1,
        0,
        {"_begin": lambda w: (F.col(mask) & ~F.coalesce(F.lag(mask).over(w), F.lit(False))).cast("long")},
        keys,
        index,
    )
    numbered = running_total(begins, keys, [index], frame_block(df, index), F.col("_begin"), "_run")
    return numbered.withColumn("run", F.when(F.col(mask), F.col("_run"))).drop("_begin", "_run")


def runs(df: DataFrame, mask: str, keys: Sequence[str] = EPISODE, index: str = "frame_index") -> DataFrame:
    """First frame, last frame and length of every maximal run."""
    return (
        run_ids(df.select(*keys, index, mask), mask, keys, index)
        .where(F.col("run").isNotNull())
        .groupBy(*keys, "run")
        .agg(F.min(index).alias("first_frame"), F.max(index).alias("last_frame"), F.count(F.lit(1)).alias("length"))
    )


def arm_velocity(frames: DataFrame, gripper: Column, column: str = "observation_state") -> DataFrame:
    """Length of the frame-to-frame step of all joints but the gripper; NULL on the first frame, 0 without an arm."""
    arm = V.without(V.widen(F.col(column)), gripper)
    return with_neighbours(
        frames.withColumn("_arm", arm), 1, 0, {"arm_velocity": lambda w: V.vec_distance(F.col("_arm"), F.lag("_arm").over(w))}
    ).drop("_arm")


def not_increasing(frames: DataFrame) -> DataFrame:
    """Frames whose timestamp is not after the one before; missing or repeated frame indices hide nothing."""
    slim = frames.select(*EPISODE, "frame_index", "timestamp")
    placed = previous(slim, EPISODE, ["frame_index", "timestamp"], frame_block(slim), "timestamp", "_before")
    return placed.where(F.col("_before") >= F.col("timestamp")).drop("_before")


def apply_autopause(ticks: DataFrame, controls: DataFrame) -> DataFrame:
    """What became of each tick of a run: captured, dropped, or skipped because the run was paused.

    ``ticks``: ``run_id``, ``captured_at_ns``, ``sequence``, ``error`` (NULL = fine). ``controls``: the same key columns
    and ``event`` (pause, resume). Three failures in a row pause the run; a resume clears them. Between two resumes
    the run pauses at most once, so the first pause of each stretch decides for all ticks behind it.
    """
    joined = ticks.select("run_id", "captured_at_ns", "sequence", "error", F.lit(None).cast("string").alias("event"))
    joined = joined.unionByName(
        controls.select("run_id", "captured_at_ns", "sequence", F.lit(None).cast("string").alias("error"), "event")
    )
    keys = ["run_id"]
    placed = placed_in_time(joined, "_i")
    fails = placed.withColumn("_fail", F.col("error").isNotNull() & F.col("event").isNull())

    def third(w):
        hit = F.col("_fail")
        for back in range(1, PAUSE_AFTER):
            hit = hit & F.coalesce(F.lag("_fail", back).over(w), F.lit(False))
        return hit

    marked = with_neighbours(fails, PAUSE_AFTER - 1, 0, {"_third": third}, keys, "_i")
    resumed = F.when(F.col("event") == "resume", 1).otherwise(0).cast("long")
    staged = running_total(marked, keys, ["_i"], frame_block(marked, "_i"), resumed, "stretch")
    pauses = F.col("_third") | (F.coalesce(F.col("event"), F.lit("")) == "pause")
    first = staged.where(pauses).groupBy("run_id", "stretch").agg(F.min("_i").alias("_pause"))
    outcome = (
        F.when(F.col("_i") > F.col("_pause"), "skipped").when(F.col("_fail"), "dropped").otherwise("captured")
    )
    return (
        staged.join(first, ["run_id", "stretch"], "left")
        .where(F.col("event").isNull())
        .withColumn("outcome", outcome)
        .withColumn("pauses", F.coalesce(F.col("_i") == F.col("_pause"), F.lit(False)))
        .drop("_i", "_fail", "_third", "_pause", "event")
    )
