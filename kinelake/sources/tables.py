"""Frame tables: the scan of the engine's own layout and the native layout it exchanges with others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.operators.blocks import EPISODE
from kinelake.schema import FRAMES

# Column names of the native layout (fixed values).
NATIVE_NAMES = {"observation_state": "observation.state", "leader_state": "leader.state"}
NATIVE_PLAIN = (
    "timestamp", "recorded_at_ns", "frame_index", "episode_index", "action", "task", "sample_sequence", "captured_at_ns",
)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames in the engine's schema; a channel the files lack reads as an empty vector.

    The schema is given, not inferred, so a file without a column costs nothing and filters reach the scan.
    """
    frames = spark.read.schema(FRAMES).parquet(path)
    empty = F.array().cast("array<float>")
    return frames.withColumns({c: F.coalesce(c, empty) for c in ("action", "leader_state")})


def episode_task(frames: DataFrame) -> DataFrame:
    """First task text of each episode that is not blank."""
    named = F.when(F.trim("task") != "", F.col("frame_index"))
    return frames.groupBy(*EPISODE).agg(F.coalesce(F.min_by("task", named), F.lit("")).alias("task"))


def read_native(spark: SparkSession, path: str, cameras: Sequence[str] = ()) -> DataFrame:
    """Native files back in the engine's names, camera column pairs folded into the camera map."""
    fields = [f for f in FRAMES.fields if f.name != "cameras"]
    native = [T.StructField(NATIVE_NAMES.get(f.name, f.name), f.dataType) for f in fields]
    pairs = [T.StructField(f"camera.{c}.{k}", T.LongType()) for c in cameras for k in ("sequence", "captured_at_ns")]
    raw = spark.read.schema(T.StructType(native + pairs)).parquet(path)
    stamps: list[Column] = []
    for c in cameras:
        stamps += [
            F.lit(c),
            F.struct(
                F.coalesce(F.col(f"`camera.{c}.sequence`"), F.lit(0)).alias("sequence"),
                F.coalesce(F.col(f"`camera.{c}.captured_at_ns`"), F.lit(0)).alias("captured_at_ns"),
            ),
        ]
    plain = [F.col(f"`{NATIVE_NAMES.get(f.name, f.name)}`").alias(f.name) for f in fields]
    kind = "map<string,struct<sequence:bigint,captured_at_ns:bigint>>"
    return raw.select(*plain, (F.create_map(*stamps) if stamps else F.create_map().cast(kind)).alias("cameras"))


def native_columns(frames: DataFrame, cameras: Sequence[str]) -> DataFrame:
    """The native layout: dotted channel names and one pair of whole-number columns per camera, absent ones 0."""
    has = set(frames.columns)
    plain = [F.col(c) for c in NATIVE_PLAIN if c in has]
    dotted = [F.col(c).alias(n) for c, n in NATIVE_NAMES.items() if c in has]
    pairs = [
        F.coalesce(F.element_at("cameras", F.lit(c))[k], F.lit(0)).cast("long").alias(f"camera.{c}.{k}")
        for c in sorted(cameras)
        for k in ("sequence", "captured_at_ns")
    ]
    return frames.select(*[c for c in ("dataset_id",) if c in has], *plain, *dotted, *pairs)


def write_native(frames: DataFrame, path: str, cameras: Sequence[str], mode: str = "errorifexists") -> None:
    """Snappy Parquet by dataset. Camera columns are part of the schema, so the cameras are named by the caller."""
    native_columns(frames, cameras).write.partitionBy("dataset_id").option("compression", "snappy").mode(mode).parquet(path)
