"""Schemas of the tables the engine stores and reads; inputs are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

JOINT_MAP = T.MapType(T.StringType(), T.DoubleType())

CAMERA_STAMP = T.StructType(
    [T.StructField("sequence", T.LongType()), T.StructField("captured_at_ns", T.LongType())]
)

# Optional calibration keys a camera may carry, handed on only where present (fixed values).
CAMERA_OPTIONAL = (
    "fov_horizontal", "fov_vertical", "fx", "fy", "cx", "cy", "distortion", "camera_model", "calibration",
)

SAMPLE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("captured_at_ns", T.LongType()),
        T.StructField("joint_names", T.ArrayType(T.StringType())),
        T.StructField("leader", JOINT_MAP),
        T.StructField("observation", JOINT_MAP),
        T.StructField("action", JOINT_MAP),
        T.StructField("units", T.StringType()),
        T.StructField("armed", T.BooleanType()),
        T.StructField("live", T.BooleanType()),
        T.StructField("leader_hardware_id", T.StringType()),
        T.StructField("follower_hardware_id", T.StringType()),
    ]
)

# What a journal keeps of a sample and of a camera frame beyond what the frame table holds.
JOURNAL_SAMPLE = T.StructType(
    [*SAMPLE.fields, T.StructField("leader_calibration_path", T.StringType()), T.StructField("follower_calibration_path", T.StringType())]
)
JOURNAL_CAMERA = T.StructType([*CAMERA_STAMP.fields, *[T.StructField(k, T.StringType()) for k in CAMERA_OPTIONAL]])
ROBOT_KEYS = ("leader_hardware_id", "follower_hardware_id", "leader_calibration_path", "follower_calibration_path")

JOURNAL_FRAME = T.StructType(
    [
        T.StructField("frame_index", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("recorded_at_ns", T.LongType()),
        T.StructField("task", T.StringType()),
        T.StructField("robot", JOURNAL_SAMPLE),
        T.StructField("cameras", T.MapType(T.StringType(), JOURNAL_CAMERA)),
        T.StructField("run_id", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

FRAMES = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("episode_index", T.LongType()),
        T.StructField("episode_id", T.StringType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("timestamp", T.FloatType()),
        T.StructField("recorded_at_ns", T.LongType()),
        T.StructField("captured_at_ns", T.LongType()),
        T.StructField("sample_sequence", T.LongType()),
        T.StructField("task", T.StringType()),
        T.StructField("joint_names", T.ArrayType(T.StringType())),
        T.StructField("observation_state", T.ArrayType(T.FloatType())),
        T.StructField("action", T.ArrayType(T.FloatType())),
        T.StructField("leader_state", T.ArrayType(T.FloatType())),
        T.StructField("cameras", T.MapType(T.StringType(), CAMERA_STAMP)),
    ]
)

CAMERA_INFO = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("frames", T.LongType()),
        T.StructField("codec", T.StringType()),
        T.StructField("pixel_format", T.StringType()),
    ]
)

TRIM = T.StructType(
    [
        T.StructField("source_frames", T.LongType()),
        T.StructField("kept_start", T.LongType()),
        T.StructField("kept_end", T.LongType()),
        T.StructField("result_frames", T.LongType()),
        T.StructField("trimmed_at", T.StringType()),
    ]
)

EPISODE_ENTRY = T.StructType(
    [
        T.StructField("episode_id", T.StringType()),
        T.StructField("episode_index", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("frames", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("task", T.StringType()),
        T.StructField("saved_at", T.StringType()),
    ]
)

# An episode as it is saved: one row beside its frames.
EPISODE_INFO = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("episode_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("episode_index", T.LongType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("completed_at", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("fps", T.LongType()),
        T.StructField("frames", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("joint_names", T.ArrayType(T.StringType())),
        T.StructField("units", T.StringType()),
        T.StructField("robot", T.StructType([T.StructField(k, T.StringType()) for k in ROBOT_KEYS])),
        T.StructField("cameras", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
        T.StructField("saved_at", T.StringType()),
    ]
)

MANIFEST_ENTRY = T.StructType([T.StructField("dataset_id", T.StringType()), *EPISODE_ENTRY.fields])

CLOSED_RUN = T.StructType([T.StructField(n, T.StringType()) for n in ("dataset_id", "run_id", "status", "closed_at")])

MANIFEST = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("fps", T.IntegerType()),
        T.StructField("task", T.StringType()),
        T.StructField("robot_type", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "features",
            T.StructType(
                [
                    T.StructField("joint_names", T.ArrayType(T.StringType())),
                    T.StructField("units", T.StringType()),
                    T.StructField("cameras", T.MapType(T.StringType(), CAMERA_INFO)),
                ]
            ),
        ),
        T.StructField("episodes", T.ArrayType(EPISODE_ENTRY)),
    ]
)

# Record kinds (fixed values of this engine's own formats).
KIND_SAMPLE = "episode.teleoperation-sample"
KIND_FRAME = "episode.frame"
KIND_STREAM_FRAME = "episode.stream-frame"
KIND_REPLAY = "episode.replay-stream"
KIND_EPISODE_REPLAY = "episode.replay"
KIND_SAMPLE_STREAM = "episode.sample-stream"
KIND_CAMERA_STREAM = "episode.frame-stream"
KIND_DATASET = "episode.dataset"
KIND_EPISODE = "episode.info"
KIND_SCHEMA = "episode.stream-schema"
KIND_POLICY_FRAME = "episode.policy-replay-frame"
SCHEMA_VERSION = 1

CHANNELS = ("leader", "observation", "action")
CHANNEL_COLUMN = {"leader": "leader_state", "observation": "observation_state", "action": "action"}
