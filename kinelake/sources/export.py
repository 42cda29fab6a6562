"""Training exports: frame, episode, feature and media tables, write modes and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import scalars as X
from kinelake.operators.aggregates import feature_stats, feature_vectors, full_episodes
from kinelake.operators.blocks import EPISODE, dense_index, frame_block
from kinelake.operators.filters import smooth
from kinelake.operators.windows import episode_offsets
from kinelake.schema import ROBOT_KEYS, SCHEMA_VERSION
from kinelake.session import block_rows, stage
from kinelake.sources import commits

# --- fixed values of the exported formats -------------------------------------------------------------------------
CODEBASE_VERSION = "v3.0"
CHUNKS_SIZE, DATA_FILES_MB, VIDEO_FILES_MB = 1000, 100, 200
DATA_PATH = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
VIDEO_PATH = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"
VECTOR_FEATURES = ("observation.state", "action")
SCALAR_FEATURES = {
    "timestamp": "float32", "frame_index": "int64", "episode_index": "int64", "index": "int64", "task_index": "int64",
}
VIDEO_CODEC, VIDEO_PIXELS, VIDEO_CHANNELS = "mpeg4", "yuv420p", 3
DEFAULT_ROBOT = "episode-robot"
# ------------------------------------------------------------------------------------------------------------------


def _floats(frames: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frames.withColumns({c: F.col(c).cast("array<float>") for c in columns})


def lerobot_frames(
    frames: DataFrame, method: str = "none", strength: float = 1.0, fps: float | str = 30.0,
    renumber: bool = True,
) -> DataFrame:
    """Frame table with frames renumbered per episode and a global index running on through each dataset's episodes.

    The global index is the episode's offset plus the frame's place in it; nothing is ordered across episodes.
    """
    # One row per episode, read for the sizes and for the join.
    offsets = stage(episode_offsets(full_episodes(frames)).select(*EPISODE, "frames", "dataset_from_index"))
    if method != "none":
        frames = smooth(frames, method, strength, fps, ("observation", "action"))
    frames = _floats(frames, ("observation_state", "action")).select(*EPISODE, "frame_index", "timestamp", "observation_state", "action")
    if renumber:
        # Short episodes are numbered and joined in one shuffle by their key.
        short = (offsets.agg(F.max("frames")).first()[0] or 0) <= block_rows(frames.sparkSession)
        frames = dense_index(frames, EPISODE, ["frame_index"], frame_block(frames), "_place", short).withColumn(
            "frame_index", F.col("_place")
        )
    return frames.join(offsets.drop("frames"), list(EPISODE)).select(
        "dataset_id",
        F.col("observation_state").alias("observation.state"),
        "action",
        F.col("timestamp").cast("float").alias("timestamp"),
        "frame_index",
        "episode_index",
        (F.col("dataset_from_index") + F.col("frame_index")).alias("index"),
        F.lit(0).cast("long").alias("task_index"),
    )


def lerobot_episodes(facts: DataFrame, cameras: Sequence[str]) -> DataFrame:
    """Episode table: length, global range, file positions, and per camera its file and time range.

    ``facts``: episode key, ``frames`` (rows present), ``fps``, ``task`` of the dataset.
    """
    ranged = episode_offsets(facts)
    zero = F.lit(0).cast("long")
    video: list[Column] = []
    for camera in cameras:
        head = f"videos/observation.images.{camera}"
        video += [
            zero.alias(f"{head}/chunk_index"),
            F.col("episode_index").alias(f"{head}/file_index"),
            F.lit(0.0).alias(f"{head}/from_timestamp"),
            (F.col("frames") / F.col("fps").cast("double")).alias(f"{head}/to_timestamp"),
        ]
    return ranged.select(
        "dataset_id",
        "episode_index",
        F.array(F.coalesce("task", F.lit(""))).alias("tasks"),
        F.col("frames").alias("length"),
        "dataset_from_index",
        "dataset_to_index",
        zero.alias("data/chunk_index"),
        F.col("episode_index").alias("data/file_index"),
        zero.alias("meta/episodes/chunk_index"),
        zero.alias("meta/episodes/file_index"),
        *video,
    )


def lerobot_features(datasets: DataFrame, cameras: DataFrame) -> DataFrame:
    """One row per feature of each dataset: ``feature, dtype, shape, names``.

    ``cameras``: ``dataset_id, camera, height, width, channels``.
    """
    joints = F.size("joint_names").cast("long")
    none = F.lit(None).cast("array<string>")
    vectors = [
        F.struct(F.lit(n).alias("feature"), F.lit("float32").alias("dtype"), F.array(joints).alias("shape"),
                 F.col("joint_names").alias("names"))
        for n in VECTOR_FEATURES
    ]
    scalars = [
        F.struct(F.lit(n).alias("feature"), F.lit(d).alias("dtype"), F.array(F.lit(1).cast("long")).alias("shape"),
                 none.alias("names"))
        for n, d in SCALAR_FEATURES.items()
    ]
    images = cameras.select(
        "dataset_id",
        F.concat(F.lit("observation.images."), "camera").alias("feature"),
        F.lit("video").alias("dtype"),
        F.array(*[F.coalesce(c, d).cast("long") for c, d in
                  (("height", F.lit(0)), ("width", F.lit(0)), ("channels", F.lit(VIDEO_CHANNELS)))]).alias("shape"),
        F.array(F.lit("height"), F.lit("width"), F.lit("channel")).alias("names"),
    )
    return datasets.select("dataset_id", F.inline(F.array(*vectors, *scalars))).unionByName(images)


def lerobot_video_info(datasets: DataFrame, cameras: DataFrame) -> DataFrame:
    """What the info document says of each camera's video: ``dataset_id, feature, info``.

    ``cameras``: ``dataset_id, camera, height, width, channels``, and where known ``codec, pixel_format, has_audio``.
    """
    def given(name: str, kind: str, default) -> Column:
        return F.coalesce(F.col(name).cast(kind) if name in cameras.columns else F.lit(None).cast(kind), F.lit(default))

    info = F.struct(
        given("height", "int", 0).alias("video.height"), given("width", "int", 0).alias("video.width"),
        given("codec", "string", VIDEO_CODEC).alias("video.codec"), given("pixel_format", "string", VIDEO_PIXELS).alias("video.pix_fmt"),
        F.lit(False).alias("video.is_depth_map"), F.col("fps").alias("video.fps"), given("channels", "int", VIDEO_CHANNELS).alias("video.channels"),
        given("has_audio", "boolean", False).alias("has_audio"),
    )
    return cameras.join(datasets.select("dataset_id", "fps"), ["dataset_id"]).select(
        "dataset_id", F.concat(F.lit("observation.images."), "camera").alias("feature"), info.alias("info")
    )


def lerobot_stats(frames: DataFrame, method: str = "none", strength: float = 1.0, fps: float | str = 30.0) -> DataFrame:
    """Statistics of each dataset's exported vectors: ``dataset_id, feature`` and min, max, mean, std, count per joint.

    They are those of the values that are exported, after smoothing.
    """
    if method != "none":
        frames = smooth(frames, method, strength, fps, ("observation", "action"))
    vectors = [F.struct(F.lit(n).alias("feature"), F.col(c).alias("vector")) for n, c in zip(VECTOR_FEATURES, ("observation_state", "action"), strict=True)]
    both = frames.select("dataset_id", F.inline(F.array(*vectors)))
    keys = ("dataset_id", "feature")
    return feature_vectors(feature_stats(both, "vector", keys), keys)


def lerobot_stats_documents(stats: DataFrame) -> DataFrame:
    """The stats document of each dataset as one JSON text."""
    entry = F.struct("feature", F.struct("min", "max", "mean", "std", "count").alias("s"))
    return stats.groupBy("dataset_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def lerobot_info(datasets: DataFrame, totals: DataFrame, features: DataFrame) -> DataFrame:
    """The info document of each dataset as columns, with its features as a map (a handful per dataset).

    ``totals``: ``dataset_id, episodes, frames``.
    """
    entry = F.struct("feature", F.struct("dtype", "shape", "names").alias("spec"))
    listed = features.groupBy("dataset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("features"))
    return datasets.join(totals, ["dataset_id"]).join(listed, ["dataset_id"]).select(
        "dataset_id",
        F.lit(CODEBASE_VERSION).alias("codebase_version"),
        "fps",
        "features",
        F.col("episodes").alias("total_episodes"),
        F.col("frames").alias("total_frames"),
        F.lit(1).alias("total_tasks"),
        F.lit(CHUNKS_SIZE).alias("chunks_size"),
        F.lit(DATA_FILES_MB).alias("data_files_size_in_mb"),
        F.lit(VIDEO_FILES_MB).alias("video_files_size_in_mb"),
        F.lit(DATA_PATH).alias("data_path"),
        F.lit(VIDEO_PATH).alias("video_path"),
        F.coalesce(X.first_present(F.col("robot_type")), F.lit(DEFAULT_ROBOT)).alias("robot_type"),
        F.create_map(F.lit("train"), F.format_string("0:%d", F.col("episodes"))).alias("splits"),
    )


def lerobot_tasks(datasets: DataFrame) -> DataFrame:
    return datasets.select("dataset_id", F.lit(0).cast("long").alias("task_index"), F.coalesce("task", F.lit("")).alias("task"))


def as_documents(rows: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Each row as one JSON document, ready for the text writer."""
    body = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != key])
    return rows.select(key, F.to_json(body).alias("value"))


# --- hub layout ---------------------------------------------------------------------------------------------------


def hub_episode_id(facts: DataFrame) -> Column:
    fallback = F.format_string("%s-episode-%06d", F.col("dataset_id"), F.col("episode_index"))
    manifest = [F.col("manifest_episode_id")] if "manifest_episode_id" in facts.columns else []
    return F.coalesce(X.first_present(F.col("episode_id"), *manifest), fallback)


def hub_frames(frames: DataFrame, facts: DataFrame) -> DataFrame:
    """Frames with the episode id the hub uses; an id already in the frames is kept."""
    ids = facts.select(*EPISODE, hub_episode_id(facts).alias("_hub_id"))
    own = F.col("episode_id") if "episode_id" in frames.columns else F.lit(None).cast("string")
    return frames.join(ids, list(EPISODE)).withColumn("episode_id", F.coalesce(own, F.col("_hub_id"))).drop("_hub_id")


def hub_episodes(facts: DataFrame, cameras: Sequence[str], with_videos: bool = True) -> DataFrame:
    """Episode table of the hub layout.

    ``facts``: episode rows joined with their manifest (``manifest_task``, ``manifest_units``, ``manifest_fps``,
    ``robot_type``) and ``row_count``. Cameras are columns here, so the dataset's cameras are named by the caller.
    """
    text = X.iso_utc
    length = F.coalesce("row_count", F.lit(0))
    files = [
        (F.format_string(f"media/videos/{c}/episode-%06d.mp4", F.col("episode_index")) if with_videos else F.lit("")).alias(
            f"{c}_file_name"
        )
        for c in sorted(cameras)
    ]
    return facts.select(
        "dataset_id",
        hub_episode_id(facts).alias("episode_id"),
        "episode_index",
        F.coalesce(X.first_present(F.col("task"), F.col("manifest_task")), F.lit("")).alias("task"),
        length.alias("frames"),
        F.col("manifest_fps").alias("fps"),
        F.coalesce(X.first_nonzero(F.col("duration_seconds")), length / F.col("manifest_fps").cast("double")).alias(
            "duration_seconds"
        ),
        F.coalesce("robot_type", F.lit("")).alias("robot_type"),
        F.coalesce(X.first_present(F.col("units"), F.col("manifest_units")), F.lit("")).alias("units"),
        F.coalesce(text(F.col("started_at")), F.lit("")).alias("started_at"),
        F.coalesce(text(F.col("completed_at")), text(F.col("saved_at")), F.lit("")).alias("completed_at"),
        *files,
    )


def hub_media(facts: DataFrame, cameras: Sequence[str]) -> DataFrame:
    """One row per episode and camera of its dataset, with the file's path and a reference the hub can decode."""
    file = F.concat(
        F.lit("videos/"), "camera", F.lit("/"), F.format_string("episode-%06d.mp4", F.col("episode_index"))
    )
    rows = hub_episodes(facts, []).withColumn("camera", F.explode(F.array(*[F.lit(c) for c in sorted(cameras)])))
    return rows.select(
        F.struct(F.lit(None).cast("binary").alias("bytes"), file.alias("path")).alias("video"),
        file.alias("video_file"),
        "dataset_id", "episode_id", "episode_index", "camera", "task", "frames", "fps", "duration_seconds",
    )


# --- training tensors ---------------------------------------------------------------------------------------------


def training_table(
    frames: DataFrame, method: str = "none", strength: float = 1.0, fps: float | str = 30.0
) -> DataFrame:
    """Content of the per-episode tensor files: single-precision vectors and the frame's clocks."""
    if method != "none":
        frames = smooth(frames, method, strength, fps)
    has = set(frames.columns)
    optional = [c for c in ("sample_sequence", "captured_at_ns", "recorded_at_ns", "cameras") if c in has]
    return _floats(frames, ("observation_state", "leader_state", "action")).select(
        *EPISODE, "frame_index",
        F.col("observation_state").alias("qpos"),
        F.col("leader_state").alias("leader"),
        "action",
        F.col("timestamp").cast("double").alias("timestamp"),
        *[F.col(c).alias("camera_metadata" if c == "cameras" else c) for c in optional],
    )


def training_attributes(
    facts: DataFrame, method: str = "none", strength: float = 1.0, exported_at: Column | None = None
) -> DataFrame:
    """One row of attributes per episode; ``facts`` may carry the episode's ``robot`` record."""
    return facts.select(
        *EPISODE,
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("manifest_fps").alias("fps"),
        F.coalesce(X.first_present(F.col("task"), F.col("manifest_task")), F.lit("")).alias("task"),
        F.coalesce("robot_type", F.lit("")).alias("robot_type"),
        F.coalesce(X.first_present(F.col("units")), F.lit("radians")).alias("units"),
        F.col("manifest_joints").alias("joint_names"),
        F.lit("RGB").alias("image_color_space"),
        F.lit((method or "none").lower()).alias("smoothing"),
        F.lit(float(strength)).alias("smoothing_strength"),
        F.concat(F.lit("datasets/"), F.col("dataset_id")).alias("source_dataset"),
        F.format_string("datasets/%s/episodes/episode-%06d", F.col("dataset_id"), F.col("episode_index")).alias("source_episode"),
        (X.iso_utc(F.current_timestamp()) if exported_at is None else exported_at).alias("exported_at"),
        # What is known of the robot, key by key; keys it has not are left out.
        (F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in ROBOT_KEYS]), F.array(*[F.col(f"robot.{k}").cast("string") for k in ROBOT_KEYS])),
                      lambda _, v: v.isNotNull()) if "robot" in facts.columns else F.create_map().cast("map<string,string>")).alias("robot"),
    )


# --- provenance and write modes -----------------------------------------------------------------------------------


def export_manifest(
    datasets: DataFrame, totals: DataFrame, kind: str, repo_id: str = "", method: str = "none", strength: float = 1.0,
    exported_at: Column | None = None,
) -> DataFrame:
    """Provenance of each dataset's export."""
    stamp = exported_at if exported_at is not None else X.iso_utc(F.current_timestamp())
    return datasets.join(totals, ["dataset_id"]).select(
        "dataset_id",
        F.lit(kind).alias("kind"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.concat(F.lit("datasets/"), "dataset_id").alias("source"),
        F.lit(repo_id).alias("repo_id"),
        "episodes",
        "frames",
        stamp.alias("exported_at"),
        F.lit((method or "none").lower()).alias("smoothing"),
        F.lit(float(strength)).alias("smoothing_strength"),
    )


def hub_manifest_rows(facts: DataFrame, cameras: Sequence[str]) -> DataFrame:
    """The portable manifest, one row per episode with its data file and media paths.

    It stays a table (one JSON line per episode): a single nested document would gather every episode in one task.
    """
    rows = hub_episodes(facts, cameras)
    paths: list[Column] = []
    for c in sorted(cameras):
        paths += [F.lit(c), F.col(f"`{c}_file_name`")]
    return rows.withColumns(
        {
            "data_file": F.format_string("data/train-%06d.parquet", F.col("episode_index")),
            "videos": F.create_map(*paths) if paths else F.create_map().cast("map<string,string>"),
        }
    )


class ExportRefused(ValueError):
    """An export that validation does not let pass. ``violations`` holds every error as rows; the text lists them up to ``LISTED``."""

    LISTED = 1000

    def __init__(self, violations: DataFrame):
        self.violations = violations
        order = [F.asc_nulls_first(c) for c in ("dataset_id", "episode_index", "rule", "message") if c in violations.columns]
        found = violations.select("message", *[c for c in ("dataset_id", "episode_index", "rule") if c in violations.columns])
        texts = [r["message"] for r in found.orderBy(*order).limit(self.LISTED + 1).collect()]
        more = f"; and {violations.count() - self.LISTED} more" if len(texts) > self.LISTED else ""
        super().__init__("validation found errors: " + "; ".join(texts[: self.LISTED]) + more)


def write_export(
    rows: DataFrame | dict[str, DataFrame], provenance: DataFrame, path: str, kind: str, action: str = "export", overwrite: bool = False,
    violations: DataFrame | None = None,
) -> str:
    """Write an export or say why not: ``checked``, ``exported``, ``exists``; anything else raises.

    Exports are gated on validation, and the error names every violation. ``rows`` is the export's table, or several by name. They
    and the provenance become visible in one commit as the next version of ``path``: a job that fails leaves the version before
    readable, and readers that hold it keep their files until ``commits.sweep``. A path holding anything else is never touched.
    """
    spark = provenance.sparkSession
    if action not in ("check", "export"):
        raise ValueError("action must be check or export")
    if violations is not None:
        errors = violations.where(F.col("severity") == "error")
        if not errors.isEmpty():
            raise ExportRefused(errors)
    if action == "check":
        return "checked"
    tables = {**(rows if isinstance(rows, dict) else {"data": rows}), "provenance": provenance.where(F.col("kind") == kind)}
    found: list[str] = []

    def change(base: commits.Snapshot) -> commits.Snapshot | None:
        if base.version < 0 and commits.names(spark, path):
            # Folders of a lost first attempt carry no record; anything else is not ours.
            if not set(commits.names(spark, path)) <= {*tables, commits.COMMITS}:
                raise ValueError(f"{path} holds data of another kind")
        if base.version >= 0 and base.notes.get("kind") != kind:
            raise ValueError(f"{path} holds data of another kind")
        if base.version >= 0 and not overwrite:
            found.append("exists")
            return None
        return commits.commit(spark, base, tables, replace=tuple(base.tables), notes={"kind": kind})

    commits.transact(spark, path, change)
    return "exists" if found else "exported"


def read_export(spark: SparkSession, path: str, table: str = "data", version: int | None = None) -> DataFrame:
    """A table of the newest export at a path, or of an earlier version that has not been swept."""
    held = commits.snapshot(spark, path, version)
    if not held.paths(table):
        raise ValueError(f"{path} holds no export with a table {table}")
    return spark.read.parquet(*held.paths(table))
