"""Row-level operators: sample checks, channel projection, frame decoding, trims, stream handles, descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import scalars as X
from kinelake.functions import vectors as V
from kinelake.operators.blocks import EPISODE
from kinelake.schema import (
    CHANNEL_COLUMN,
    CHANNELS,
    KIND_EPISODE_REPLAY,
    KIND_FRAME,
    KIND_REPLAY,
    KIND_SAMPLE,
    KIND_SAMPLE_STREAM,
    SCHEMA_VERSION,
)

# --- fixed values -------------------------------------------------------------------------------------------------
STALE_AFTER_FLOOR = 0.05
DEFAULT_FPS = 30.0
DEFAULT_UNITS = "radians"
MIN_RATE = 0.01
MIN_PACE = 1e-3
PLAYBACK_SOURCES = ("action", "observation", "leader")
# ------------------------------------------------------------------------------------------------------------------


def sample_reason(now_ns: Column, stale_after: float, require_armed: bool) -> Column:
    """First reason a teleoperation sample cannot be recorded, NULL when it can."""
    limit = max(STALE_AFTER_FLOOR, stale_after)
    age = X.age_seconds(F.col("captured_at_ns"), now_ns)
    names = F.col("joint_names")

    def covered(channel: str) -> Column:
        return F.forall(names, lambda n: F.map_contains_key(F.col(channel), n))

    reason = F.when(
        F.coalesce(F.col("kind"), F.lit("")) != KIND_SAMPLE, F.lit(f"unexpected kind, wanted {KIND_SAMPLE}")
    ).when(
        age > limit,
        F.concat(F.lit("robot sample too old ("), X.stale_detail(F.col("captured_at_ns"), age, limit), F.lit(")")),
    )
    if require_armed:
        reason = reason.when(~F.coalesce(F.col("armed"), F.lit(False)), F.lit("robot not armed"))
    return (
        reason.when(~F.coalesce(F.col("live"), F.lit(False)), F.lit("robot not live"))
        .when(
            names.isNull() | (F.size(names) == 0) | ~F.coalesce(covered("observation"), F.lit(False)),
            F.lit("observed joints missing or out of order"),
        )
        .when(
            ~F.coalesce(covered("action"), F.lit(False)), F.lit("action lacks a listed joint")
        )
    )


def validate_samples(df: DataFrame, now_ns: Column, stale_after: float = 0.5, require_armed: bool = True) -> DataFrame:
    """Adds ``reason`` (NULL = valid) and ``age_seconds``."""
    return df.withColumns(
        {
            "age_seconds": X.age_seconds(F.col("captured_at_ns"), now_ns),
            "reason": sample_reason(now_ns, stale_after, require_armed),
        }
    )


def check_source(source: str) -> str:
    name = (source or "action").strip().lower()
    if name not in PLAYBACK_SOURCES:
        raise ValueError("unknown source, choose action, observation or leader")
    return name


def positions(frames: DataFrame, source: str, out: str = "positions") -> DataFrame:
    """Joint values of one channel in joint order; a joint without a value reads 0."""
    vector = F.col(CHANNEL_COLUMN[check_source(source)])
    return frames.withColumn(
        out, F.transform("joint_names", lambda _, i: F.coalesce(F.get(vector, i).cast("double"), F.lit(0.0)))
    )


def frame_records(frames: DataFrame, session_task: Column | None = None) -> DataFrame:
    """Stored vectors decoded to joint maps, with defaults for absent values."""
    task = X.first_present(F.col("task"), session_task if session_task is not None else F.lit(""))
    maps = {c: V.named(F.col(CHANNEL_COLUMN[c]), F.col("joint_names")) for c in CHANNELS}
    has = set(frames.columns)

    def whole(name: str) -> Column:
        return (F.coalesce(F.col(name), F.lit(0)) if name in has else F.lit(0)).cast("long").alias(name)

    cameras = F.col("cameras") if "cameras" in has else F.create_map().cast(
        "map<string,struct<sequence:bigint,captured_at_ns:bigint>>"
    )
    return frames.select(
        *EPISODE,
        F.lit(KIND_FRAME).alias("kind"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "frame_index",
        F.coalesce(F.col("timestamp").cast("double"), F.lit(0.0)).alias("timestamp"),
        whole("recorded_at_ns"),
        whole("sample_sequence"),
        whole("captured_at_ns"),
        F.coalesce(task, F.lit("")).alias("task"),
        "joint_names",
        *[maps[c].alias(c) for c in CHANNELS],
        F.transform_values(
            cameras,
            lambda _, s: F.struct(
                F.coalesce(s["sequence"], F.lit(0)).alias("sequence"),
                F.coalesce(s["captured_at_ns"], F.lit(0)).alias("captured_at_ns"),
            ),
        ).alias("cameras"),
    )


# --- trims --------------------------------------------------------------------------------------------------------


def trim_status(start: Column, end: Column, total: Column) -> Column:
    """NULL for an acceptable keep range, else the refusal."""
    bad = (total <= 0) | (start < 0) | (end >= total) | (start > end)
    return F.when(bad, F.format_string("invalid trim range %d..%d for %d frames", start, end, total)).when(
        (start == 0) & (end == total - 1), F.lit("nothing to trim: all frames kept")
    )


def check_trim(trims: DataFrame, episodes: DataFrame) -> DataFrame:
    """Trim requests with the episode's frame count and a refusal where one applies."""
    joined = trims.join(episodes.select(*EPISODE, "frames", "fps"), list(EPISODE))
    return joined.withColumn(
        "error", trim_status(F.col("keep_start").cast("long"), F.col("keep_end").cast("long"), F.col("frames"))
    )


def trim(frames: DataFrame, trims: DataFrame) -> DataFrame:
    """Keep ``keep_start..keep_end`` of each accepted request, renumbered from 0; all other columns stay.

    ``trims`` holds accepted requests (``check_trim`` without errors) and their ``fps``; episodes without a request
    pass through.
    """
    requests = trims.select(*EPISODE, "keep_start", "keep_end", F.col("fps").alias("_fps"))
    shifted = F.col("frame_index") - F.coalesce("keep_start", F.lit(0))
    paced = (shifted / F.greatest(F.col("_fps"), F.lit(1)).cast("double")).cast("float")
    kept = F.col("keep_start").isNull() | F.col("frame_index").between(F.col("keep_start"), F.col("keep_end"))
    return (
        frames.join(requests, list(EPISODE), "left")
        .where(kept)
        .withColumns(
            {
                "timestamp": F.when(F.col("keep_start").isNull(), F.col("timestamp")).otherwise(paced),
                "frame_index": shifted,
            }
        )
        .drop("keep_start", "keep_end", "_fps")
    )


def cut(cuts: DataFrame, episodes: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Before/after cuts turned into keep ranges; refused sides, active datasets and void ranges carry ``error``."""
    side = F.lower(F.trim(F.col("side")))
    joined = cuts.join(episodes.select(*EPISODE, "frames", "fps"), list(EPISODE))
    if active is not None:
        busy = active.select("dataset_id").distinct().withColumn("_active", F.lit(True))
        joined = joined.join(busy, ["dataset_id"], "left")
    else:
        joined = joined.withColumn("_active", F.lit(None).cast("boolean"))
    last = F.greatest(F.lit(0), F.col("frames") - 1)
    at = X.clamp(F.col("frame_index"), F.lit(0), last)
    ranged = joined.withColumns(
        {
            "keep_start": F.when(side == "before", at).when(side == "after", F.lit(0)).cast("long"),
            "keep_end": F.when(side == "before", F.col("frames") - 1).when(side == "after", at).cast("long"),
        }
    )
    error = (
        F.when(F.col("_active"), F.lit("dataset is being recorded, trim refused"))
        .when(~side.isin("before", "after") | side.isNull(), F.lit("side to trim is one of: 'before' or 'after'"))
        .otherwise(trim_status(F.col("keep_start"), F.col("keep_end"), F.col("frames")))
    )
    return ranged.withColumn("error", error).drop("_active")


def apply_trim_metadata(episodes: DataFrame, trims: DataFrame, trimmed_at: Column | None = None) -> DataFrame:
    """Episode rows after their accepted trims: frames, duration and one more history entry."""
    requests = trims.select(*EPISODE, "keep_start", "keep_end")
    stamp = (trimmed_at if trimmed_at is not None else F.lit(None)).cast("string")
    kept = F.col("keep_end") - F.col("keep_start") + 1
    entry = F.struct(
        F.col("frames").cast("long").alias("source_frames"),
        F.col("keep_start").cast("long").alias("kept_start"),
        F.col("keep_end").cast("long").alias("kept_end"),
        kept.cast("long").alias("result_frames"),
        stamp.alias("trimmed_at"),
    )
    empty = F.array().cast(
        "array<struct<source_frames:bigint,kept_start:bigint,kept_end:bigint,result_frames:bigint,trimmed_at:string>>"
    )
    history = F.coalesce(F.col("trim_history"), empty) if "trim_history" in episodes.columns else empty
    hit = F.col("keep_start").isNotNull()
    return (
        episodes.join(requests, list(EPISODE), "left")
        .withColumns(
            {
                "trim_history": F.when(hit, F.concat(history, F.array(entry))).otherwise(history),
                "removed_frames": F.when(hit, F.col("frames") - kept).otherwise(F.lit(0)).cast("long"),
                "duration_seconds": F.when(hit, X.duration_seconds(kept, F.col("fps"))).otherwise(
                    F.col("duration_seconds")
                ),
                "frames": F.when(hit, kept).otherwise(F.col("frames")).cast("long"),
            }
        )
        .drop("keep_start", "keep_end")
    )


# --- stream handles -----------------------------------------------------------------------------------------------


def classify_stream(df: DataFrame) -> DataFrame:
    """Adds ``mode`` (inline, replay, sample) from ``kind``, ``token``, ``url``, ``has_frames``; or ``error``."""
    kind = F.coalesce(F.col("kind"), F.lit(""))
    present = {c: F.coalesce(F.col(c), F.lit("")) != "" for c in ("token", "url")}
    mode = (
        F.when((kind == KIND_REPLAY) & F.coalesce(F.col("has_frames"), F.lit(False)), "inline")
        .when((kind == KIND_REPLAY) | ((kind == "") & present["token"]), "replay")
        .when((kind == KIND_SAMPLE_STREAM) | ((kind == "") & present["url"]), "sample")
    )
    return df.withColumn("mode", mode).withColumn(
        "error", F.when(F.col("mode").isNull(), F.lit("no source given: replay or sample stream wanted"))
    )


def resolve_playback(df: DataFrame) -> DataFrame:
    """Playback settings from the request, then the session, then the defaults."""
    fps = F.coalesce(X.first_nonzero(F.col("fps"), F.col("session_fps")), F.lit(DEFAULT_FPS)).cast("double")
    rate = F.greatest(F.lit(MIN_RATE), F.coalesce(X.first_nonzero(F.col("rate")), F.lit(1.0)).cast("double"))
    units = F.coalesce(
        F.nullif(F.col("units"), F.lit("")), F.nullif(F.col("session_units"), F.lit("")), F.lit(DEFAULT_UNITS)
    )
    return df.withColumns({"play_fps": fps, "play_rate": rate, "play_units": units}).withColumn(
        "period_seconds", F.lit(1.0) / F.greatest(F.lit(MIN_PACE), F.col("play_fps") * F.col("play_rate"))
    )


# --- catalog rows -------------------------------------------------------------------------------------------------


def register_datasets(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """What each create request leads to: create, reopen, conflict or a bad id."""
    known = datasets.select(
        "dataset_id", F.col("fps").alias("_fps"), F.col("task").alias("_task"), F.lit(True).alias("_known")
    )
    blank = F.coalesce(F.trim(F.col("task")), F.lit("")) == ""
    status = (
        F.when(F.col("dataset_id").isNull(), "invalid id")
        .when(F.col("_known").isNull(), "create")
        .when(F.col("_fps") != F.col("fps"), "conflict: fps")
        .when(~blank & (F.col("_task") != F.trim(F.col("task"))), "conflict: task")
        .otherwise("reopen")
    )
    return (
        requests.withColumn("dataset_id", X.slug(F.col("requested_id")))
        .join(known, ["dataset_id"], "left")
        .withColumn("status", status)
        .drop("_fps", "_task", "_known")
    )


def describe(datasets: DataFrame, episodes: DataFrame) -> DataFrame:
    """Short descriptor of each dataset; one without episodes counts 0."""
    counts = episodes.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_n"))
    path = F.col("path") if "path" in datasets.columns else F.concat(F.lit("datasets/"), F.col("dataset_id"))
    return datasets.join(counts, ["dataset_id"], "left").select(
        "dataset_id", path.alias("path"), "fps", "task", F.coalesce("_n", F.lit(0)).alias("episode_count")
    )


# --- lookups ------------------------------------------------------------------------------------------------------


def frame_at(frames: DataFrame, requests: DataFrame, episodes: DataFrame) -> DataFrame:
    """The requested frame of each episode, clamped into it; an empty episode gives no row."""
    sizes = episodes.select(*EPISODE, F.col("frames").alias("_n")).where(F.col("_n") > 0)
    wanted = (
        requests.withColumnRenamed("frame_index", "requested_index")
        .join(sizes, list(EPISODE))
        .withColumn("frame_index", X.clamp(F.col("requested_index"), F.lit(0), F.col("_n") - 1).cast("long"))
        .withColumnRenamed("_n", "frames")
    )
    return wanted.join(frames, [*EPISODE, "frame_index"])


def browse(datasets: DataFrame, episodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolve (dataset, episode, camera) choices to an episode; ``error`` names an unknown camera.

    A dataset that does not exist falls back to the first in case-insensitive order, an episode is clamped, a blank
    camera means the first by name.
    """
    first = datasets.agg(F.min_by("dataset_id", F.struct(F.lower("dataset_id"), F.col("dataset_id"))).alias("_first"))
    known = datasets.select(F.col("dataset_id").alias("_known"))
    counts = episodes.groupBy("dataset_id").agg(
        F.max("episode_index").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    asked = F.trim(F.coalesce(F.col("requested_dataset"), F.lit("")))
    resolved = (
        requests.join(known, asked == F.col("_known"), "left")
        .withColumn("dataset_id", F.coalesce(F.col("_known"), first.scalar()))
        .join(counts, ["dataset_id"])
        .withColumn(
            "episode_index",
            X.clamp(F.coalesce(F.col("requested_episode"), F.lit(0)).cast("long"), F.lit(0), F.col("_last")),
        )
    )
    info = episodes.select(
        *EPISODE, "frames", "fps", "units", "task", "duration_seconds", "joint_names",
        F.sort_array("cameras").alias("cameras"), *[c for c in ("robot", "camera_info", "saved_at") if c in episodes.columns],
    )
    joined = resolved.join(info, list(EPISODE))
    wish = F.trim(F.coalesce(F.col("requested_camera"), F.lit("")))
    camera = F.when(wish != "", wish).otherwise(F.coalesce(F.get("cameras", F.lit(0)), F.lit("")))
    listing = F.when(F.size("cameras") == 0, F.lit("none")).otherwise(F.concat_ws(", ", "cameras"))
    return (
        joined.withColumn("camera", camera)
        .withColumn(
            "error",
            F.when(
                ~F.array_contains("cameras", F.col("camera")),
                F.concat(F.lit("camera '"), F.col("camera"), F.lit("' not recorded; there are: "), listing),
            ),
        )
        .drop("_known", "_last", "_n")
    )


def replay_descriptor(datasets: DataFrame, episodes: DataFrame, requests: DataFrame) -> DataFrame:
    """What a player needs of the episode and camera a request resolves to: places, timing, joints, robot and camera facts.

    ``episodes`` may carry ``robot`` (a struct), ``camera_info`` (map from camera to its facts) and ``saved_at``; absent ones read
    empty. ``datasets`` may carry ``path``. A request with an ``error`` names no files.
    """
    place = F.col("path") if "path" in datasets.columns else F.concat(F.lit("datasets/"), F.col("dataset_id"))
    paths = datasets.select("dataset_id", place.alias("dataset_path"))
    rows = browse(datasets, episodes, requests).join(paths, ["dataset_id"])
    has, ok = set(rows.columns), F.col("error").isNull()
    folder = F.concat("dataset_path", F.format_string("/episodes/episode-%06d", F.col("episode_index")))
    none = F.create_map().cast("map<string,string>")
    info = F.coalesce(F.element_at("camera_info", F.col("camera")), none) if "camera_info" in has else none
    robot = F.map_filter(F.from_json(F.to_json("robot"), "map<string,string>"), lambda _, v: v.isNotNull()) if "robot" in has else none
    kept = [c for c in requests.columns]
    return rows.select(
        *kept, F.lit(KIND_EPISODE_REPLAY).alias("kind"), F.lit(SCHEMA_VERSION).alias("schema_version"), "dataset_id", "dataset_path",
        F.when(ok, folder).alias("episode_path"), F.when(ok, F.concat(folder, F.lit("/data.parquet"))).alias("data_path"),
        F.when(ok, F.concat(folder, F.lit("/cameras/"), "camera", F.lit(".mp4"))).alias("video_path"), "episode_index", "camera",
        info.alias("camera_info"), "cameras", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("fps", F.lit(0)).alias("fps"),
        F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"), "joint_names", F.coalesce("units", F.lit("")).alias("units"),
        F.coalesce(robot, none).alias("robot"), F.coalesce("task", F.lit("")).alias("task"),
        (F.coalesce(F.col("saved_at").cast("string"), F.lit("")) if "saved_at" in has else F.lit("")).alias("saved_at"), "error",
    )


def preview(raw: DataFrame, smoothed: DataFrame, channel: str, joint: int) -> DataFrame:
    """Raw and smoothed values of one joint; an unknown channel reads as action, an unknown joint as the first."""
    name = channel if channel in CHANNELS else "action"
    column = CHANNEL_COLUMN[name]

    def series(df: DataFrame, out: str) -> DataFrame:
        at = F.when(F.size(column) > joint, F.lit(joint)).otherwise(F.lit(0)) if joint >= 0 else F.lit(0)
        return df.select(*EPISODE, "frame_index", F.get(F.col(column), at).cast("double").alias(out))

    return series(raw, "raw").join(series(smoothed, "smoothed"), [*EPISODE, "frame_index"])


# --- de-duplication -----------------------------------------------------------------------------------------------


def dedupe_cameras_last(handles: DataFrame, kind: str) -> DataFrame:
    """One handle per (request, camera): the last value, at the place of the first; invalid handles are only counted.

    Input ``request_id``, ``source`` (list, single, socket), ``position``, ``kind``, ``stream_id``, ``snapshot_url``.
    The chained list comes first, then the single handle, then numbered sockets by number.
    """
    rank = F.when(F.col("source") == "list", 0).when(F.col("source") == "single", 1).otherwise(2)
    place = F.struct(rank.alias("r"), F.col("position").alias("p"))
    stream = F.trim(F.coalesce(F.col("stream_id"), F.lit("")))
    ok = (F.col("kind") == kind) & (stream != "") & (F.trim(F.coalesce("snapshot_url", F.lit(""))) != "")
    marked = handles.select("request_id", stream.alias("stream_id"), "snapshot_url", place.alias("_place"),
                            F.coalesce(ok, F.lit(False)).alias("_ok"))
    kept = (
        marked.where("_ok")
        .groupBy("request_id", "stream_id")
        .agg(F.max_by("snapshot_url", "_place").alias("snapshot_url"), F.min("_place").alias("_place"))
    )
    ordered = Window.partitionBy("request_id").orderBy("_place")
    ignored = marked.groupBy("request_id").agg(F.count_if(~F.col("_ok")).alias("ignored"))
    return (
        ignored.join(kept, ["request_id"])
        .withColumn("position", F.row_number().over(ordered) - 1)
        .drop("_place")
    )


def dedupe_cameras_first(handles: DataFrame, kind: str) -> DataFrame:
    """One handle per (request, camera), the first given; a blank id means ``camera``; ``error`` where refused."""
    stream = X.first_present(F.trim(F.col("stream_id")), F.lit("camera"))
    wrong = F.coalesce(F.col("kind"), F.lit("")) != kind
    marked = handles.withColumns({"stream_id": stream, "_wrong": wrong})
    refused = marked.groupBy("request_id").agg(
        F.when(F.max("_wrong"), F.lit(f"every camera must be of kind {kind} handles")).alias("error")
    )
    kept = marked.where(~F.col("_wrong")).groupBy("request_id", "stream_id").agg(
        F.min_by("snapshot_url", "position").alias("snapshot_url"), F.min("position").alias("position")
    )
    return refused.join(kept, ["request_id"], "left").withColumn(
        "error", F.when(F.col("error").isNull() & F.col("stream_id").isNull(),
                        F.lit("no camera given")).otherwise(F.col("error"))
    )


def union_frames(*tables: DataFrame) -> DataFrame:
    """Episodes from several tables; a column one of them lacks reads NULL."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def camera_names(frames: DataFrame) -> DataFrame:
    """Every camera that appears in an episode's frames."""
    return frames.select(*EPISODE, F.explode(F.map_keys("cameras")).alias("camera")).distinct()
