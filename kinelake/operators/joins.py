"""Joins: stream synchronisation, manifests, replay events, joint retargeting, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions import scalars as X
from kinelake.functions import vectors as V
from kinelake.operators.aggregates import full_episodes
from kinelake.operators.blocks import EPISODE, bounded_blocks, carry, frame_block
from kinelake.operators.projections import STALE_AFTER_FLOOR, positions
from kinelake.operators.windows import DAY_NS, time_block

SMALL_SIDE_BYTES = 32 << 20


def small_side(df: DataFrame, most: int = SMALL_SIDE_BYTES) -> DataFrame:
    """Broadcast a dimension only after measuring that it is small; otherwise the planner joins it as it sees fit.

    The measure is the size of its rows as JSON, added up by the executors.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


# --- synchronisation ----------------------------------------------------------------------------------------------


def camera_reason(camera: str, snapshot: Column, now_ns: Column, limit: float) -> Column:
    captured = snapshot["captured_at_ns"]
    age = X.age_seconds(captured, now_ns)
    detail = X.stale_detail(captured, age, limit)
    return F.when(
        age > limit, F.concat(F.lit(f"camera {camera} frame too old ("), detail, F.lit(")"))
    ).when(snapshot["empty"], F.lit(f"camera {camera} sent no picture"))


def sync_streams(
    samples: DataFrame, cameras: DataFrame, names: Sequence[str], stale_after: float = 0.5, width: int = DAY_NS
) -> DataFrame:
    """Each sample with the latest snapshot of every named camera; ``reason`` tells why a sample has to be dropped.

    Both streams are merged by time and the last snapshot of each camera is carried along: linear, no pairs.
    """
    limit = max(STALE_AFTER_FLOOR, stale_after)
    stamp = F.struct("sequence", "captured_at_ns", "empty")
    left = samples.select("run_id", "captured_at_ns", "sequence", F.lit(1).alias("_side"))
    right = cameras.where(F.col("camera").isin(*names)).select(
        "run_id", "captured_at_ns", "sequence", F.lit(0).alias("_side"), "camera", stamp.alias("_stamp")
    )
    merged = left.unionByName(right, allowMissingColumns=True)
    slot = {n: f"cam_{i}" for i, n in enumerate(names)}
    latest = {slot[n]: F.when(F.col("camera") == n, F.col("_stamp")) for n in names}
    keys, order = ["run_id"], ["captured_at_ns", "_side", "sequence"]
    held, block = bounded_blocks(merged, keys, order, time_block("captured_at_ns", width))
    filled = carry(held, keys, order, block, latest).where(F.col("_side") == 1)
    reason = F.coalesce(*[camera_reason(n, F.col(slot[n]), F.col("captured_at_ns"), limit) for n in names])
    stamps = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]),
        F.array(
            *[
                F.struct(
                    F.col(slot[n])["sequence"].alias("sequence"),
                    F.col(slot[n])["captured_at_ns"].alias("captured_at_ns"),
                )
                for n in names
            ]
        ),
    )
    return filled.select("run_id", "captured_at_ns", "sequence", stamps.alias("cameras"), reason.alias("reason"))


# --- manifests ----------------------------------------------------------------------------------------------------


def episode_facts(datasets: DataFrame, episodes: DataFrame, frames: DataFrame) -> DataFrame:
    """Declared episodes with their dataset's settings and the rows actually present (NULL = no frame data)."""
    manifest = datasets.select(
        "dataset_id", F.col("fps").alias("manifest_fps"), F.col("task").alias("manifest_task"),
        F.col("joint_names").alias("manifest_joints"), F.col("units").alias("manifest_units"), "robot_type",
    )
    counts = full_episodes(frames).withColumnRenamed("frames", "row_count")
    return episodes.join(manifest, ["dataset_id"], "left").join(counts, list(EPISODE), "left")


def recoverable(journals: DataFrame, episodes: DataFrame) -> DataFrame:
    """Journals no saved episode came from, with the frames they hold and what can be done."""
    saved = episodes.select("dataset_id", "run_id")
    message = F.when(
        F.col("frames") == 0, "unfinished run without frames, discard it to record again"
    ).otherwise("unfinished run, save or discard it to record again")
    return (
        journals.join(saved, ["dataset_id", "run_id"], "left_anti")
        .withColumn("duration_seconds", X.duration_seconds(F.col("frames"), F.col("fps")))
        .withColumn("message", message)
    )


def saved_runs(journals: DataFrame, episodes: DataFrame) -> DataFrame:
    return journals.join(episodes.select("dataset_id", "run_id"), ["dataset_id", "run_id"], "left_semi")


def recover(journals: DataFrame, episodes: DataFrame, actions: DataFrame) -> DataFrame:
    """Outcome of save/discard requests on unfinished runs; runs to save go on to compaction."""
    open_runs = recoverable(journals, episodes).select("dataset_id", "run_id", "frames")
    action = F.lower(F.trim("action"))
    joined = actions.join(open_runs, ["dataset_id", "run_id"], "left")
    status = (
        F.when(~F.coalesce(action.isin("save", "finalize", "discard"), F.lit(False)),
               "unknown action, choose save, finalize or discard")
        .when(F.col("frames").isNull(), "no such unfinished episode")
        .when(action == "discard", "discarded")
        .when(F.col("frames") == 0, "episode without frames not saved")
        .otherwise("saved")
    )
    return joined.withColumn("status", status)


# --- replay -------------------------------------------------------------------------------------------------------


def publisher_keys(publishers: DataFrame) -> DataFrame:
    """One row per token a synchronised replay publisher answers to; the three lineage columns become one key."""
    tokens = F.array_distinct(F.array_compact(F.array("token", "source_token", "lineage_token")))
    return (
        publishers.where(F.col("sync") & F.col("mode").isin("replay", "inline"))
        .select("publisher_id", F.explode(tokens).alias("token"))
        .where(F.col("token") != "")
    )


def replay_targets(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events with the clamped frame they point at, or the reason they are refused.

    ``sessions``: ``token``, episode key and ``frames``.
    """
    event = F.lower(F.trim(F.coalesce(F.col("event"), F.lit(""))))
    error = (
        F.when(~event.isin("play", "seek"), "unknown replay event, choose play or seek")
        .when(F.col("frames").isNull(), "selection no longer known")
        .when(F.col("frames") <= 0, "selection holds no frames")
    )
    at = X.clamp(F.col("requested_index"), F.lit(0), F.col("frames") - 1).cast("long")
    return (
        events.withColumnRenamed("frame_index", "requested_index")
        .join(sessions, ["token"], "left")
        .withColumns({"event": event, "error": error})
        .withColumn("frame_index", F.when(F.col("error").isNull(), at))
    )


def replay_events(events: DataFrame, publishers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every event with its resolved frame and how many publishers it reached."""
    reach = publisher_keys(publishers).groupBy("token").agg(F.count(F.lit(1)).alias("_reach"))
    return (
        replay_targets(events, sessions)
        .join(reach, ["token"], "left")
        .withColumn("publishers", F.when(F.col("error").isNull(), F.coalesce("_reach", F.lit(0))).otherwise(F.lit(0)))
        .drop("_reach")
    )


def replay_deliveries(
    events: DataFrame, publishers: DataFrame, sessions: DataFrame, frames: DataFrame, source: str
) -> DataFrame:
    """One row per accepted event and publisher it reaches, with the frame's positions."""
    accepted = replay_targets(events, sessions).where(F.col("error").isNull()).drop("error")
    pose = positions(frames, source).select(*EPISODE, "frame_index", "joint_names", "positions")
    # The pose is looked up once per event, before events fan out to publishers.
    return accepted.join(pose, [*EPISODE, "frame_index"]).join(publisher_keys(publishers), ["token"])


# --- joint mapping ------------------------------------------------------------------------------------------------


def joint_values(frames: DataFrame, source: str) -> DataFrame:
    placed = positions(frames, source)
    pairs = F.arrays_zip(F.col("joint_names").alias("joint"), F.col("positions").alias("value"))
    return placed.select(*EPISODE, "frame_index", F.explode(pairs).alias("_p")).select(
        *EPISODE, "frame_index", F.col("_p.joint").alias("joint"), F.col("_p.value").alias("value")
    )


def retarget(frames: DataFrame, mapping: DataFrame, source: str = "action", units: str = "radians") -> DataFrame:
    """Linear joint mapping; unmapped joints and non-finite values are left out, radians turn a rotation by degrees.

    ``mapping``: ``joint``, ``target`` (attribute), ``scale``, ``offset``.
    """
    mapped = joint_values(frames, source).where(V.is_finite(F.col("value"))).join(small_side(mapping), ["joint"])
    out = F.col("value") * F.coalesce("scale", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0))
    rotational = F.lower("target").contains(".rotate") & F.lit((units or "radians").startswith("rad"))
    return mapped.select(
        *EPISODE, "frame_index", "joint", "target", F.when(rotational, F.degrees(out)).otherwise(out).alias("output")
    )


def retarget_home(
    frames: DataFrame, mapping: DataFrame, calibration: DataFrame, dofs: DataFrame, source: str = "action"
) -> DataFrame:
    """Mapping relative to calibrated home poses; a joint without a mapping drives the target of its own name.

    ``mapping``: ``joint``, ``dof``, ``sign``, ``scale``; ``calibration``: ``joint``, ``calibrated``, ``sim_home``,
    ``dataset_home`` (NULL = the first frame of the trajectory); ``dofs``: ``dof``.
    """
    values = joint_values(frames, source)
    first = values.where(F.col("frame_index") == 0).select(*EPISODE, "joint", F.col("value").alias("_first"))
    joined = (
        values.where(V.is_finite(F.col("value")))
        .join(small_side(mapping), ["joint"], "left")
        .withColumn("dof", F.coalesce(F.nullif("dof", F.lit("")), F.col("joint")))
        .join(small_side(dofs.select("dof")), ["dof"], "left_semi")
        .join(small_side(calibration), ["joint"], "left")
        .join(first, [*EPISODE, "joint"], "left")
    )
    gain = F.coalesce("sign", F.lit(1.0)) * F.coalesce("scale", F.lit(1.0))
    home = F.coalesce(F.col("dataset_home"), F.col("_first"))
    out = F.when(
        F.coalesce("calibrated", F.lit(False)), F.col("sim_home") + gain * (F.col("value") - home)
    ).otherwise(F.col("value") * gain)
    return joined.select(*EPISODE, "frame_index", "joint", "dof", out.alias("output"))


def reorder(frames: DataFrame, target_order: Sequence[str], source: str = "action") -> DataFrame:
    """Positions in the receiver's own joint order; a joint the frame lacks reads 0."""
    placed = positions(frames, source)
    return placed.withColumn(
        "ordered", V.pick(V.named(F.col("positions"), F.col("joint_names")), F.array(*[F.lit(n) for n in target_order]))
    )


def policy_error(predictions: DataFrame, frames: DataFrame, channel: str = "action") -> DataFrame:
    """Predicted against recorded joint targets of the same frame.

    ``predictions``: episode key, ``frame_index``, ``prediction`` (vector).
    """
    target = positions(frames, channel, "target").select(*EPISODE, "frame_index", "target")
    return predictions.join(target, [*EPISODE, "frame_index"]).withColumn(
        "absolute_error", V.vec_absdiff(F.col("prediction"), F.col("target"))
    )


def frames_in_segments(marks: DataFrame, segments: DataFrame) -> DataFrame:
    """The segment ``[start_frame, end_frame)`` each marked frame lies in; frames outside all segments are left out.

    Segments of an episode do not overlap, so the last one begun is carried along the frames; no range join.
    """
    body = F.struct("start_frame", "end_frame", "tag")
    begun = segments.select(*EPISODE, F.col("start_frame").alias("frame_index"), F.lit(0).alias("_side"), body.alias("_seg"))
    marked = marks.withColumn("_side", F.lit(1))
    merged = marked.unionByName(begun, allowMissingColumns=True)
    filled = carry(merged, EPISODE, ["frame_index", "_side"], frame_block(merged), {"segment": F.col("_seg")})
    return (
        filled.where((F.col("_side") == 1) & (F.col("frame_index") < F.col("segment.end_frame")))
        .select(*[c for c in marks.columns], "segment.start_frame", "segment.end_frame", "segment.tag")
    )
