"""Replay rows for subscribers: one JSON text per frame, and the timeline they are due at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.operators.blocks import EPISODE
from kinelake.operators.projections import MIN_PACE, MIN_RATE, check_source, frame_records


def wire_rows(
    frames: DataFrame, episodes: DataFrame, source: str, run_id: Column, rate: float = 1.0, event: str = "autoplay",
    seq: Column | None = None,
) -> DataFrame:
    """Frames as subscribers receive them. ``episodes``: episode key, ``frames``, ``fps``, ``units``."""
    source = check_source(source)
    records = frame_records(frames)
    values = F.transform("joint_names", lambda n: F.coalesce(F.element_at(F.col(source), n), F.lit(0.0)))
    info = episodes.select(*EPISODE, "frames", "fps", "units")
    return records.join(info, list(EPISODE)).select(
        "*",
        F.lit(float(rate)).alias("rate"),
        F.lit(source).alias("source"),
        values.alias("positions"),
        (seq if seq is not None else F.col("frame_index")).alias("seq"),
        run_id.alias("run_id"),
        F.lit(event).alias("playback_event"),
    )


def to_wire(rows: DataFrame) -> DataFrame:
    """Key and JSON value, as the Kafka and text sinks take them."""
    body = F.struct(*[c for c in rows.columns if c not in EPISODE])
    return rows.select(
        *EPISODE, "frame_index", F.concat_ws("/", *EPISODE).alias("key"), F.to_json(body).alias("value")
    )


def paced_timeline(frames: DataFrame, episodes: DataFrame, rate: float = 1.0, loops: int = 1) -> DataFrame:
    """When each frame is due, in seconds after the start, over a number of loops; ``seq`` runs on through them."""
    period = F.lit(1.0) / F.greatest(F.lit(MIN_PACE), F.col("fps") * F.lit(max(MIN_RATE, rate)))
    repeated = frames.join(episodes.select(*EPISODE, "frames", "fps"), list(EPISODE)).withColumn(
        "loop", F.explode(F.sequence(F.lit(0), F.lit(max(1, loops) - 1)))
    )
    seq = F.col("loop") * F.col("frames") + F.col("frame_index")
    return repeated.withColumns({"seq": seq.cast("long"), "due_seconds": seq * period})
