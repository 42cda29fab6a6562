"""Streaming sources: teleoperation samples as JSON messages, camera frames as opaque files with JSON sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.schema import CAMERA_OPTIONAL, KIND_SAMPLE, KIND_STREAM_FRAME, SAMPLE, SCHEMA_VERSION

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

SIDECAR = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("camera", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("captured_at_ns", T.LongType()),
        *[T.StructField(k, T.StringType()) for k in CAMERA_OPTIONAL],
    ]
)


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as a stream of messages (a Kafka source gives the same ``value`` column)."""
    return spark.readStream.text(path)


def parse_samples(messages: DataFrame) -> DataFrame:
    """``value`` texts to samples; ``error`` for a message that is no sample, which is kept as ``value``."""
    parsed = messages.withColumn("s", F.from_json("value", SAMPLE))
    error = F.when(
        F.col("s").isNull() | ~F.col("s.kind").eqNullSafe(F.lit(KIND_SAMPLE)),
        F.lit("unexpected kind, wanted teleoperation sample"),
    )
    keep = [c for c in messages.columns if c != "value"]
    return parsed.select(*keep, "s.*", error.alias("error"), F.when(error.isNotNull(), F.col("value")).alias("value"))


def stream_frames(samples: DataFrame) -> DataFrame:
    """Live samples as stream frames: no end (``frames`` = 0), wall-clock timestamp. They are counted by ``number_frames``."""
    empty = F.create_map().cast("map<string,double>")
    return samples.where(F.col("error").isNull()).select(
        *[c for c in ("run_id",) if c in samples.columns],
        F.lit(KIND_STREAM_FRAME).alias("kind"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(0).cast("long").alias("frames"),
        F.col("sequence"),
        (F.coalesce("captured_at_ns", F.lit(0)) / F.lit(1e9)).alias("timestamp"),
        F.coalesce("captured_at_ns", F.lit(0)).alias("captured_at_ns"),
        F.coalesce("joint_names", F.array().cast("array<string>")).alias("joint_names"),
        *[F.coalesce(c, empty).alias(c) for c in ("leader", "observation", "action")],
    )


def sample_stream(spark: SparkSession, path: str) -> DataFrame:
    return stream_frames(parse_samples(text_stream(spark, path)))


def attach_sidecars(payloads: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Camera frames from payload files and their metadata; payloads stay opaque, calibration keys pass if present.

    ``payloads``: ``path, content`` (and ``length``); ``sidecars``: ``SIDECAR``. Works for tables and streams alike.
    """
    named = payloads.withColumn("file", F.element_at(F.split("path", "/"), -1))
    pairs = [F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in CAMERA_OPTIONAL]
    given = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
    return named.join(sidecars, ["file"]).select(
        "run_id",
        "camera",
        F.coalesce("sequence", F.lit(0)).alias("sequence"),
        F.coalesce("captured_at_ns", F.lit(0)).alias("captured_at_ns"),
        "path",
        (F.length("content") == 0).alias("empty"),
        given.alias("calibration"),
    )


def attach_late_sidecars(payloads: DataFrame, sidecars: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Camera frames from a stream of payload files and a stream of their metadata, whichever of the two comes first.

    ``payloads``: ``path, modificationTime, content``; ``sidecars``: ``SIDECAR`` and ``written_at``. A file and its metadata find
    each other when they were written at most ``late`` apart. A file that waits longer leaves with ``described`` false and no
    capture time, which the checks on samples refuse; metadata that waits longer leaves as an empty frame without a path, as file
    readers pass over files without bytes. Only names, times and sizes wait in the state, never pictures.
    """
    near = F.expr(f"INTERVAL {late}")
    left = payloads.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("_name"), F.coalesce(F.length("content") == 0, F.lit(True)).alias("_empty"), "modificationTime"
    )
    right = sidecars.withColumn("described", F.lit(True))
    if payloads.isStreaming:
        left, right = left.withWatermark("modificationTime", late), right.withWatermark("written_at", late)
    same = (
        (F.col("_name") == F.col("file")) & (F.col("written_at") >= F.col("modificationTime") - near) & (F.col("written_at") <= F.col("modificationTime") + near)
    )
    pairs = [F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in CAMERA_OPTIONAL]
    return left.join(right, same, "full").select(
        "run_id",
        "camera",
        F.coalesce("sequence", F.lit(0)).alias("sequence"),
        F.coalesce("captured_at_ns", F.lit(0)).alias("captured_at_ns"),
        "path",
        F.coalesce("_empty", F.lit(True)).alias("empty"),
        F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())).alias("calibration"),
        F.coalesce("described", F.lit(False)).alias("described"),
    )


def camera_stream(spark: SparkSession, folder: str, sidecar_folder: str, late: str = "10 minutes", pattern: str = "*.jpg") -> DataFrame:
    """Stream of camera frames from a folder of payload files and one of JSON sidecars; either may come first."""
    payloads = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema(BINARY_FILE).load(folder)
    sidecars = spark.readStream.schema(SIDECAR).json(sidecar_folder).withColumn("written_at", F.col("_metadata.file_modification_time"))
    return attach_late_sidecars(payloads, sidecars, late)
