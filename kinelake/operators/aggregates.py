"""Grouped results: summaries, feature statistics, success statistics, smoothness, capture counters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions import scalars as X
from kinelake.functions import vectors as V
from kinelake.operators.blocks import (
    BLOCK,
    EPISODE,
    exact_quantiles,
    frame_block,
    with_neighbours,
)
from kinelake.operators.projections import positions
from kinelake.schema import CHANNEL_COLUMN, KIND_SCHEMA, SCHEMA_VERSION
from kinelake.session import stage

# --- fixed values -------------------------------------------------------------------------------------------------
CAMERA_CHANNELS = 3
JERK_FLOOR = 1e-12
BOUNDS_TOLERANCE = 1e-4
BOUNDS_FLOOR = 1e-5
FINGERPRINT = ("grip_slip", "n_stall", "n_segments", "max_tracking_error", "n_move")
Z_THRESHOLD = 3.0
# ------------------------------------------------------------------------------------------------------------------


def full_episodes(frames: DataFrame) -> DataFrame:
    """Frames per episode, counted."""
    return frames.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("frames"))


def long_form(frames: DataFrame, channels: Sequence[str] = ("observation",)) -> DataFrame:
    """One row per (episode, frame, channel, joint)."""
    parts = F.array(
        *[F.struct(F.lit(c).alias("channel"), V.widen(F.col(CHANNEL_COLUMN[c])).alias("vector")) for c in channels]
    )
    keep = [c for c in (BLOCK, "_home") if c in frames.columns]
    return (
        frames.select(*EPISODE, "frame_index", *keep, F.explode(parts).alias("_p"))
        .select(*EPISODE, "frame_index", *keep, "_p.channel", F.posexplode("_p.vector").alias("joint", "value"))
    )


# --- catalog ------------------------------------------------------------------------------------------------------


def summarize(datasets: DataFrame, episodes: DataFrame, recoverable: DataFrame) -> DataFrame:
    """One row per dataset: totals over its episodes, its cameras and joints, how many runs are unfinished.

    The runs themselves stay a table (``recoverable``): a list of them would grow with the data.
    """
    totals = episodes.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("episode_count"),
        F.sum("frames").alias("total_frames"),
        F.sum(F.coalesce("duration_seconds", F.lit(0.0))).alias("duration_seconds"),
    )
    open_runs = recoverable.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("incomplete"), F.min("run_id").alias("first_incomplete")
    )
    return (
        datasets.join(totals, ["dataset_id"], "left")
        .join(open_runs, ["dataset_id"], "left")
        .withColumns(
            {
                "episode_count": F.coalesce("episode_count", F.lit(0)),
                "total_frames": F.coalesce("total_frames", F.lit(0)),
                "duration_seconds": F.coalesce("duration_seconds", F.lit(0.0)),
                "incomplete": F.coalesce("incomplete", F.lit(0)),
                "cameras": F.sort_array("cameras"),
            }
        )
    )


def camera_shapes(cameras: DataFrame) -> DataFrame:
    """Camera resolutions of a dataset; width and height default to 0, channels to 3."""
    return cameras.select(
        "dataset_id",
        "camera",
        F.coalesce("width", F.lit(0)).cast("int").alias("width"),
        F.coalesce("height", F.lit(0)).cast("int").alias("height"),
        F.coalesce(X.first_nonzero(F.col("channels")), F.lit(CAMERA_CHANNELS)).cast("int").alias("channels"),
    )


def catalog(summaries: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """All datasets in case-insensitive order with the number of valid ones; unreadable ones keep their error."""
    count = summaries.agg(F.count(F.lit(1)).alias("n"))
    listed = summaries.withColumn("error", F.lit(None).cast("string"))
    if invalid is not None:
        listed = listed.unionByName(invalid.select("dataset_id", "error"), allowMissingColumns=True)
    return listed.withColumn("dataset_count", count.scalar()).orderBy(F.lower("dataset_id"), "dataset_id")


def summary_report(summaries: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """One line per dataset. With ``shapes`` (``camera_shapes``) each camera is named with its resolution."""
    if shapes is not None:
        shape = F.struct("camera", F.format_string("%s %dx%dx%d", F.col("camera"), F.col("width"), F.col("height"), F.col("channels")).alias("text"))
        listed = shapes.groupBy("dataset_id").agg(F.array_sort(F.collect_list(shape)).alias("_s"))  # the cameras of a dataset
        summaries = summaries.join(listed.select("dataset_id", F.col("_s.text").alias("_shapes")), ["dataset_id"], "left")
        summaries = summaries.withColumn("cameras", F.coalesce("_shapes", F.array().cast("array<string>")))
    cameras = F.coalesce(F.nullif(F.concat_ws(", ", "cameras"), F.lit("")), F.lit("unknown"))
    text = F.format_string(
        "%d episode(s), %d frames; cameras: %s", F.col("episode_count"), F.col("total_frames"), cameras
    )
    return summaries.select("dataset_id", text.alias("report"))


def export_totals(frames: DataFrame, media: DataFrame) -> DataFrame:
    """Episodes, frames and media files of each dataset's export."""
    # Per-episode counts first: a distinct count over all frames would shuffle every frame's key.
    sizes = full_episodes(frames).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("frames").alias("frames")
    )
    files = media.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("media"))
    return sizes.join(files, ["dataset_id"], "left").withColumn("media", F.coalesce("media", F.lit(0)))


# --- vectors ------------------------------------------------------------------------------------------------------


def feature_stats(frames: DataFrame, column: str, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Per-position min, max, mean, population deviation and count, one row per position."""
    return (
        frames.select(*keys, F.posexplode(V.widen(F.col(column))).alias("joint", "value"))
        .groupBy(*keys, "joint")
        .agg(
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.count("value").alias("count"),
        )
    )


def feature_vectors(stats: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """The same statistics as vectors in joint order (one entry per joint, so small)."""
    entry = F.struct("joint", "min", "max", "mean", "std", "count")
    rows = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    return rows.select(*keys, *[F.col("_s")[n].alias(n) for n in ("min", "max", "mean", "std", "count")])


def tracking_error(frames: DataFrame) -> DataFrame:
    """Largest gap between command and achieved state per joint; only where both have the same width."""
    gap = V.vec_absdiff(F.col("action"), F.col("observation_state"))
    return (
        frames.where(F.size("action") == F.size("observation_state"))
        .select(*EPISODE, F.posexplode(gap).alias("joint", "gap"))
        .groupBy(*EPISODE, "joint")
        .agg(F.max("gap").alias("max_error"))
    )


def jerk_rms(frames: DataFrame, channels: Sequence[str] = ("action",)) -> DataFrame:
    """Root mean square of the third difference per (episode, channel) over all joints; 0 with fewer than four frames.

    A joint that one of the four vectors lacks is left out there.
    """
    columns = [CHANNEL_COLUMN[c] for c in channels]
    lags = {
        f"_{c}_{k}": (lambda w, c=c, k=k: F.lag(c, k).over(w)) for c in columns for k in (1, 2, 3)
    }
    lagged = with_neighbours(frames.select(*EPISODE, "frame_index", *columns), 3, 0, lags)

    def thirds(column: str) -> Column:
        near = [F.col(f"_{column}_{k}") for k in (1, 2, 3)]

        def third(x: Column, j: Column) -> Column:
            one, two, three = [F.get(v, j).cast("double") for v in near]
            return x.cast("double") - 3 * one + 3 * two - three

        return F.filter(F.transform(F.col(column), third), lambda d: d.isNotNull())

    def squares(column: str) -> Column:
        return F.aggregate(F.col(column), F.lit(0.0), lambda a, d: a + d * d)

    differences = lagged.select(*EPISODE, *[thirds(c).alias(c) for c in columns])
    sums = differences.select(
        *EPISODE, *[squares(c).alias(f"_{c}_s") for c in columns],
        *[F.coalesce(F.size(c), F.lit(0)).alias(f"_{c}_n") for c in columns],
    )

    def one(column: str) -> Column:
        total, count = F.coalesce(F.sum(f"_{column}_s"), F.lit(0.0)), F.sum(F.greatest(f"_{column}_n", F.lit(0)))
        return F.coalesce(F.sqrt(F.try_divide(total, count)), F.lit(0.0))

    wide = sums.groupBy(*EPISODE).agg(*[one(col).alias(c) for c, col in zip(channels, columns)])
    return wide.unpivot(list(EPISODE), list(channels), "channel", "jerk_rms")


def reduction(raw: Column, smooth: Column) -> Column:
    """Jerk taken away by smoothing, in percent, never negative."""
    return F.when(raw > JERK_FLOOR, F.greatest(F.lit(0.0), (1 - smooth / raw) * 100)).otherwise(F.lit(0.0))


def jerk_reduction(raw: DataFrame, smoothed: DataFrame, channel: str = "action") -> DataFrame:
    """Jerk before and after, and the reduction in percent, of the previewed channel."""
    before = jerk_rms(raw, [channel]).withColumnRenamed("jerk_rms", "jerk_raw")
    after = jerk_rms(smoothed, [channel]).withColumnRenamed("jerk_rms", "jerk_smoothed")
    return before.join(after, [*EPISODE, "channel"]).withColumn(
        "jerk_reduction_pct", reduction(F.col("jerk_raw"), F.col("jerk_smoothed"))
    )


def bounds(points: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Axis-aligned box of each path."""
    return points.groupBy(*keys).agg(
        *[F.min(a).alias(f"min_{a}") for a in "xyz"], *[F.max(a).alias(f"max_{a}") for a in "xyz"]
    )


def bounds_include(outer: dict[str, Column], inner: dict[str, Column]) -> Column:
    """Whether ``inner`` lies in ``outer`` within a tolerance that grows with the larger box."""
    spans = [F.greatest(F.lit(0.0), outer[f"max_{a}"] - outer[f"min_{a}"]) for a in "xyz"]
    slack = F.greatest(F.greatest(*spans) * BOUNDS_TOLERANCE, F.lit(BOUNDS_FLOOR))
    held = F.lit(True)
    for a in "xyz":
        held = held & (inner[f"min_{a}"] >= outer[f"min_{a}"] - slack) & (inner[f"max_{a}"] <= outer[f"max_{a}"] + slack)
    return held


def lower_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """The element at ``(n - 1) // 2`` of the sorted values, not interpolated."""
    return exact_quantiles(df, keys, value, {out: 0.5}, interpolate=False)


def mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Lower median and the lower median of the distances from it."""
    centre = stage(lower_median(df, keys, value).select(*keys, "median"))
    gaps = df.join(centre, list(keys)).withColumn("_gap", F.abs(F.col(value) - F.col("median")))
    return centre.join(lower_median(gaps, keys, "_gap", "mad").select(*keys, "mad"), list(keys))


# --- outcomes -----------------------------------------------------------------------------------------------------


def episode_stats(episodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Attempts, evaluated episodes, successes and the success rate of each dataset.

    A verdict without a decision counts as evaluated but not as a success.
    """
    judged = verdicts.select(*EPISODE, "success", F.lit(True).alias("_judged"))
    success = F.coalesce(F.col("success"), F.lit(False))
    return (
        episodes.join(judged, list(EPISODE), "left")
        .groupBy("dataset_id")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.count("_judged").alias("evaluated"),
            F.count_if(success & F.col("_judged").isNotNull()).alias("successes"),
        )
        .withColumn(
            "success_rate", F.coalesce(F.try_divide(F.col("successes"), F.col("evaluated")), F.lit(0.0))
        )
    )


def failure_breakdown(verdicts: DataFrame) -> DataFrame:
    """How often each stage failed, most frequent first, ties by the first episode that showed it."""
    failed = ~F.coalesce(F.col("success"), F.lit(False)) & (F.coalesce(F.trim("failed_stage"), F.lit("")) != "")
    return (
        verdicts.where(failed)
        .groupBy("dataset_id", F.col("failed_stage").alias("stage"))
        .agg(F.count(F.lit(1)).alias("count"), F.min("episode_index").alias("first_episode"))
        .orderBy("dataset_id", F.desc("count"), "first_episode", "stage")
    )


def top_failure(verdicts: DataFrame) -> DataFrame:
    place = F.struct(F.col("count"), -F.col("first_episode"))
    return failure_breakdown(verdicts).groupBy("dataset_id").agg(
        F.max_by("stage", place).alias("stage"), F.max("count").alias("count")
    )


def unpivot_features(features: DataFrame) -> DataFrame:
    return features.unpivot(
        list(EPISODE), [F.col(c).cast("double").alias(c) for c in FINGERPRINT], "feature", "value"
    )


def build_reference(features: DataFrame, good: DataFrame) -> DataFrame:
    """Mean and population deviation of each fingerprint feature over known-good episodes; an absent value reads 0."""
    chosen = features.join(good.select(*EPISODE), list(EPISODE), "left_semi")
    return (
        unpivot_features(chosen)
        .groupBy("feature")
        .agg(
            F.avg(F.coalesce("value", F.lit(0.0))).alias("mean"),
            F.stddev_pop(F.coalesce("value", F.lit(0.0))).alias("std"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def feature_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """All feature names of two reference tables and whether both hold them."""
    a = left.select("feature", F.lit(True).alias("_l")).distinct()
    b = right.select("feature", F.lit(True).alias("_r")).distinct()
    return a.join(b, ["feature"], "full").select(
        "feature", (F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("overlap")
    )


# --- capture ------------------------------------------------------------------------------------------------------


def capture_status(ticks: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Captured and dropped ticks of each run, failures since the last capture, and the error still standing.

    ``ticks`` carries ``captured_at_ns``, ``sequence`` and ``error`` (NULL = captured).
    """
    place = F.struct("captured_at_ns", "sequence")
    last_good = ticks.where(F.col("error").isNull()).groupBy(*keys).agg(F.max(place).alias("_good"))
    # A struct key pair compares in order, so the join needs one row per run only.
    since = F.col("_good").isNull() | (place > F.col("_good"))
    return (
        ticks.join(last_good, list(keys), "left")
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("error").isNull()).alias("captured"),
            F.count_if(F.col("error").isNotNull()).alias("dropped"),
            F.count_if(F.col("error").isNotNull() & since).alias("consecutive_errors"),
            F.coalesce(
                F.max_by("error", F.when(F.col("error").isNotNull() & since, place)), F.lit("")
            ).alias("last_error"),
        )
    )


# --- whole trajectories -------------------------------------------------------------------------------------------


def trajectory_payload(
    frames: DataFrame, episodes: DataFrame, source: str, method: str | None = None, strength: float = 0.0
) -> DataFrame:
    """The ordered trajectory of each episode for subscribers that draw whole paths.

    A long episode is handed out in parts of one block each (``part`` of ``parts``, ``first_frame`` tells where it
    starts), so no row outgrows a task; an ordinary episode is a single part.
    """
    placed = positions(frames, source).withColumn("part", frame_block(frames))
    ordered = F.array_sort(F.collect_list(F.struct("frame_index", "positions")))
    parts = placed.groupBy(*EPISODE, "part").agg(
        F.min_by("joint_names", "frame_index").alias("joint_names"), ordered.alias("_t")
    )
    size = frame_block(frames, "frames_minus_one")
    info = episodes.select(
        *EPISODE, F.col("frames"), "fps", "units", (F.col("frames") - 1).alias("frames_minus_one")
    ).withColumn("parts", size + 1)
    out = parts.join(info, list(EPISODE)).select(
        *EPISODE,
        F.lit(KIND_SCHEMA).alias("kind"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "part",
        "parts",
        F.get("_t", F.lit(0))["frame_index"].alias("first_frame"),
        "joint_names",
        F.lit(source).alias("source"),
        F.coalesce(F.nullif("units", F.lit("")), F.lit("radians")).alias("units"),
        F.col("_t.positions").alias("trajectory"),
        "frames",
        "fps",
    )
    if method:
        out = out.withColumn(
            "smoothing", F.struct(F.lit(method).alias("method"), F.lit(float(strength)).alias("strength"))
        )
    return out
