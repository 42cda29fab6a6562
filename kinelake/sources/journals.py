"""Capture journals: JSON lines of frames, and their compaction into episode frame tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.functions import scalars as X
from kinelake.functions import vectors as V
from kinelake.operators.blocks import EPISODE, RANGE, bounded_blocks, dense_index
from kinelake.operators.joins import recover
from kinelake.schema import (
    CAMERA_OPTIONAL, CLOSED_RUN, EPISODE_INFO, FRAMES, JOURNAL_FRAME, KIND_EPISODE, MANIFEST_ENTRY, ROBOT_KEYS, SCHEMA_VERSION,
)
from kinelake.session import stage
from kinelake.sources import commits

FRAME_JSON = T.StructType([f for f in JOURNAL_FRAME.fields if f.name != "_corrupt_record"])


def frame_from_json(col: Column) -> Column:
    return F.from_json(col, FRAME_JSON)


def frame_to_json(records: DataFrame) -> Column:
    """A decoded frame as one journal line."""
    robot = F.struct(
        F.col("sample_sequence").alias("sequence"), "captured_at_ns", "joint_names", "leader", "observation", "action"
    )
    return F.to_json(
        F.struct("frame_index", "timestamp", "recorded_at_ns", "task", robot.alias("robot"), "cameras")
    )


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal frames with their run: named in the line itself, else by the folder of the file.

    Blank lines are skipped. An unreadable line has no frame fields, only ``_corrupt_record``.
    """
    lines = spark.read.schema(JOURNAL_FRAME).option("mode", "PERMISSIVE").json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return lines.withColumn("run_id", F.coalesce("run_id", folder))


def journal_vectors(journal: DataFrame) -> DataFrame:
    """Journal rows with joint maps laid out as vectors in joint order; absent numbers read 0.

    Joint order is the sample's ``joint_names``, or the order of its observation where it names none.
    """
    names = F.coalesce(
        F.when(F.size("robot.joint_names") > 0, F.col("robot.joint_names")), F.map_keys("robot.observation")
    )

    def vector(channel: str) -> Column:
        return F.transform(names, lambda n: F.element_at(F.col(f"robot.{channel}"), n).cast("float"))

    zero = F.lit(0).cast("long")
    # Unreadable lines carry no robot record and are no frames.
    return journal.where(F.col("robot").isNotNull()).select(
        "run_id",
        "frame_index",
        F.col("timestamp").cast("float").alias("timestamp"),
        F.coalesce("recorded_at_ns", zero).alias("recorded_at_ns"),
        F.coalesce("robot.captured_at_ns", zero).alias("captured_at_ns"),
        F.coalesce("robot.sequence", zero).alias("sample_sequence"),
        F.coalesce("task", F.lit("")).alias("task"),
        names.alias("joint_names"),
        vector("observation").alias("observation_state"),
        vector("action").alias("action"),
        vector("leader").alias("leader_state"),
        F.map_keys("robot.observation").alias("observation_order"),
        F.map_keys("robot.action").alias("action_order"),
        F.coalesce(F.nullif("robot.units", F.lit("")), F.lit("radians")).alias("units"),
        F.transform_values("cameras", lambda _, v: F.struct(v["sequence"].alias("sequence"), v["captured_at_ns"].alias("captured_at_ns"))).alias("cameras"),
    )


def check_journal(vectors: DataFrame, runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Why a run cannot be saved, one row per run; NULL ``error`` when it can.

    ``runs`` carries ``run_id`` and ``dataset_id``; ``datasets`` the joint order of earlier episodes (or NULL).
    """
    first = F.min_by("joint_names", "frame_index")
    per_run = vectors.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("frames"),
        first.alias("joint_names"),
        F.min("joint_names").alias("_lo"),
        F.max("joint_names").alias("_hi"),
        F.count_if(
            (F.col("observation_order") != F.col("joint_names")) | (F.col("action_order") != F.col("joint_names"))
        ).alias("_off"),
        F.min_by("units", "frame_index").alias("units"),
    )
    known = datasets.select("dataset_id", F.col("joint_names").alias("_known"))
    error = (
        F.when(F.coalesce("frames", F.lit(0)) == 0, "episode without frames not saved")
        .when((F.col("_lo") != F.col("_hi")) | (F.col("_off") > 0),
              "joint order changes within the run")
        .when(F.col("_known").isNotNull() & (F.col("_known") != F.col("joint_names")),
              "joint order is not that of the saved episodes")
    )
    return (
        runs.join(per_run, ["run_id"], "left")
        .join(known, ["dataset_id"], "left")
        .withColumn("frames", F.coalesce("frames", F.lit(0)))
        .withColumn("error", error)
        .drop("_lo", "_hi", "_off", "_known")
    )


def assign_episode_index(runs: DataFrame, existing: DataFrame) -> DataFrame:
    """Number the runs of each dataset after its saved episodes, by start time.

    ``existing`` holds ``dataset_id`` and ``saved`` (how many episodes it has).
    """
    block = F.floor(F.unix_micros(F.col("started_at").cast("timestamp")) / F.lit(86_400_000_000)).cast("long")
    keys, order = ["dataset_id"], ["started_at", "run_id"]
    held, block = bounded_blocks(runs, keys, order, block)
    placed = dense_index(held, keys, order, block, "_place").drop(RANGE)
    return (
        placed.join(existing.select("dataset_id", "saved"), ["dataset_id"], "left")
        .withColumn("episode_index", F.col("_place") + F.coalesce("saved", F.lit(0)))
        .drop("_place", "saved")
    )


def compact_journals(journal: DataFrame, runs: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn journals into (frame table, episode rows); refused runs stay in the episode rows with their ``error``.

    ``runs``: ``run_id``, ``dataset_id``, ``episode_index``, ``fps``, ``task``, ``started_at``.
    """
    vectors = journal_vectors(journal)
    checked = check_journal(vectors, runs, datasets).withColumn(
        "duration_seconds", X.duration_seconds(F.col("frames"), F.col("fps"))
    )
    episodes = checked.withColumn(
        "episode_id", F.concat(F.lit("episode-"), X.identity_token(F.col("dataset_id"), F.col("run_id")))
    )
    good = episodes.where(F.col("error").isNull()).select("run_id", *EPISODE, "episode_id")
    frames = vectors.drop("observation_order", "action_order", "units").join(good, ["run_id"])
    return frames, episodes


def all_frames_writable(vectors: DataFrame) -> Column:
    """A journal refuses values that are not finite."""
    return (
        V.all_finite(F.col("observation_state")) & V.all_finite(F.col("action")) & V.all_finite(F.col("leader_state"))
    )


# --- saving -------------------------------------------------------------------------------------------------------


def run_facts(journal: DataFrame) -> DataFrame:
    """What a run's first frame says beside its vectors: hardware, and the calibration of each camera (only keys it has)."""

    def given(camera: Column) -> Column:
        pairs = [F.struct(F.lit(k).alias("key"), camera[k].alias("value")) for k in CAMERA_OPTIONAL]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))

    robot = F.struct(*[F.col(f"robot.{k}").alias(k) for k in ROBOT_KEYS])
    cameras = F.transform_values("cameras", lambda _, c: given(c))
    first = F.struct(robot.alias("robot"), cameras.alias("cameras"))
    # The cameras of a run are those of any of its frames; maps are no keys, so their names are gathered (a handful per run).
    named = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("cameras")))))
    rows = journal.where(F.col("robot").isNotNull()).groupBy("run_id").agg(
        F.min_by(first, "frame_index").alias("_first"), named.alias("_names")
    )
    none = F.create_map().cast("map<string,string>")
    cameras = F.map_from_arrays(F.col("_names"), F.transform("_names", lambda n: F.coalesce(F.col("_first.cameras")[n], none)))
    return rows.select("run_id", F.col("_first.robot").alias("robot"), cameras.alias("cameras"))


def known_joints(checked: DataFrame, datasets: DataFrame, saved: DataFrame) -> DataFrame:
    """The joint order that runs of a dataset must have: of its saved episodes, else of its manifest, else of the earliest sound
    run among those to be saved now."""
    earlier = saved.groupBy("dataset_id").agg(F.max_by("joint_names", "episode_index").alias("_saved"))
    sound = checked.where(F.col("error").isNull())
    now = sound.groupBy("dataset_id").agg(F.min_by("joint_names", F.struct("started_at", "run_id")).alias("_now"))
    both = datasets.select("dataset_id", F.col("joint_names").alias("_given")).join(earlier, ["dataset_id"], "full").join(now, ["dataset_id"], "full")
    return both.select("dataset_id", F.coalesce("_saved", "_given", "_now").alias("joint_names"))


def _texts(stamp: Column) -> Column:
    return X.iso_utc(stamp.cast("timestamp"))


def close_runs(
    journal: DataFrame, runs: DataFrame, datasets: DataFrame, actions: DataFrame, root: str, at: Column | None = None
) -> tuple[commits.Snapshot, DataFrame]:
    """Carry out save and discard requests on unfinished runs; the new version of the tables and what became of each request.

    ``runs``: ``run_id, dataset_id, fps, task, started_at``; ``datasets``: ``dataset_id, joint_names`` (NULL before the first
    episode); ``actions``: ``dataset_id, run_id, action``. Tables below ``root``: ``frames``, ``episodes``, ``manifest`` and
    ``closed`` (runs that are saved or discarded). They change in one commit, so a saved run has its frames, episode row and
    manifest entry, or none of them. Repeating the call after a lost job, or after success, leads to the same tables. A
    dataset's episodes are numbered on from those of the version the commit builds on; when another writer commits in between,
    they are numbered again.
    """
    spark = journal.sparkSession
    vectors = journal_vectors(journal)
    held = vectors.groupBy("run_id").agg(F.count(F.lit(1)).alias("frames"))
    open_runs = runs.join(held, ["run_id"], "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    stamp = F.current_timestamp() if at is None else at
    outcome: list[DataFrame] = []

    def change(base: commits.Snapshot) -> commits.Snapshot | None:
        saved = base.read(spark, "episodes", EPISODE_INFO)
        closed = base.read(spark, "closed", CLOSED_RUN)
        left = open_runs.join(closed.select("dataset_id", "run_id"), ["dataset_id", "run_id"], "left_anti")
        asked = recover(left, saved, actions).select("dataset_id", "run_id", "action", "status")
        to_save = left.join(asked.where("status = 'saved'").select("dataset_id", "run_id").distinct(), ["dataset_id", "run_id"]).drop("frames")
        nothing = datasets.select("dataset_id", F.lit(None).cast("array<string>").alias("joint_names")).limit(0)
        alone = check_journal(vectors, to_save, nothing)
        checked = check_journal(vectors, to_save, known_joints(alone, datasets, saved))
        count = saved.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("saved"))
        good = assign_episode_index(checked.where(F.col("error").isNull()), count).select("run_id", "episode_index")
        # Numbers and verdicts are read by every table that is written, so they are settled once.
        settled = stage(checked.join(good, ["run_id"], "left").withColumn("at", stamp))
        result = asked.join(settled.select("dataset_id", "run_id", "error", "episode_index", "frames"), ["dataset_id", "run_id"], "left")
        result = stage(result.withColumn("status", F.coalesce("error", "status")).drop("error"))
        outcome[:] = [result]
        done = result.where("status in ('saved', 'discarded')").select("dataset_id", "run_id", "status").distinct()
        if done.isEmpty():
            return None
        numbered = settled.where(F.col("error").isNull())
        episodes = (
            numbered.join(run_facts(journal), ["run_id"], "left")
            .withColumns({
                "kind": F.lit(KIND_EPISODE), "schema_version": F.lit(SCHEMA_VERSION), "fps": F.col("fps").cast("long"),
                "episode_id": F.concat(F.lit("episode-"), X.identity_token(F.col("dataset_id"), F.col("run_id"))),
                "started_at": _texts(F.col("started_at")), "completed_at": _texts(F.col("at")), "saved_at": _texts(F.col("at")),
                "task": F.coalesce("task", F.lit("")), "duration_seconds": X.duration_seconds(F.col("frames"), F.col("fps")),
            })
        )
        episodes = episodes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EPISODE_INFO.fields])
        manifest = episodes.withColumn("path", F.format_string("episodes/episode-%06d", F.col("episode_index")))
        ids = episodes.select("run_id", *EPISODE, "episode_id")
        frames = vectors.join(ids, ["run_id"]).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FRAMES.fields])
        return commits.commit(
            spark, base,
            {
                "frames": frames, "episodes": episodes, "manifest": manifest.select(*[f.name for f in MANIFEST_ENTRY.fields]),
                "closed": done.withColumn("closed_at", _texts(stamp)),
            },
        )

    return commits.transact(spark, root, change), outcome[0]


def saved_tables(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """Frames, episode rows, manifest entries and closed runs of one version."""
    held = commits.snapshot(spark, root, version)
    kinds = {"frames": FRAMES, "episodes": EPISODE_INFO, "manifest": MANIFEST_ENTRY, "closed": CLOSED_RUN}
    return {table: held.read(spark, table, kind) for table, kind in kinds.items()}


def dataset_features(episodes: DataFrame) -> DataFrame:
    """Joint order, units and cameras of each dataset, as its last saved episode has them."""
    last = F.max_by(F.struct("joint_names", "units", "cameras"), "episode_index").alias("_f")
    return episodes.groupBy("dataset_id").agg(last).select("dataset_id", "_f.*")
