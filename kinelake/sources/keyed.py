"""Frames laid out for lookups: folders by a bucket of (episode, run of frames), so that a lookup reads only the buckets it names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.operators.blocks import EPISODE
from kinelake.operators.joins import publisher_keys, replay_targets
from kinelake.operators.projections import positions
from kinelake.schema import FRAMES
from kinelake.session import block_rows
from kinelake.sources import commits

BUCKETS = 64
#: Files of a bucket, so that writing one is not a single task.
FILES = 1
TABLE = "frames"


@dataclass(frozen=True)
class KeyedFrames:
    """A frame table by bucket, and what a key's bucket depends on."""

    frames: DataFrame
    buckets: int
    run: int

    def bucket(self, episode: tuple[str, ...] = EPISODE, index: str = "frame_index") -> Column:
        return frame_bucket(self.buckets, self.run, episode, index)


def frame_bucket(buckets: int, run: int, episode: tuple[str, ...] = EPISODE, index: str = "frame_index") -> Column:
    """A long episode lies in many buckets: its frames change bucket after every ``run`` of them."""
    return F.pmod(F.xxhash64(*episode, F.floor(F.col(index) / run).cast("long")), F.lit(buckets)).cast("int")


def write_keyed(frames: DataFrame, root: str, buckets: int = BUCKETS, files: int = FILES, run: int | None = None) -> commits.Snapshot:
    """The frames as the next version of a keyed table; one shuffle, each file in the order of its keys."""
    spark = frames.sparkSession
    run = run or block_rows(spark)
    slot = F.pmod(F.xxhash64(F.lit(1), *EPISODE, F.floor(F.col("frame_index") / run)), F.lit(files))
    held = [f.name for f in FRAMES.fields if f.name in frames.columns]
    laid = (
        frames.select(*held, frame_bucket(buckets, run).alias("bucket")).repartition(buckets * files, "bucket", slot)
        .sortWithinPartitions("bucket", *EPISODE, "frame_index")
    )
    notes = {"buckets": str(buckets), "run": str(run)}
    return commits.transact(
        spark, root, lambda base: commits.commit(spark, base, {TABLE: laid}, replace=(TABLE,), notes=notes, by={TABLE: ("bucket",)})
    )


def read_keyed(spark: SparkSession, root: str, version: int | None = None) -> KeyedFrames:
    held = commits.snapshot(spark, root, version)
    kind = T.StructType([*FRAMES.fields, T.StructField("bucket", T.IntegerType())])
    return KeyedFrames(held.read(spark, TABLE, kind), int(held.notes.get("buckets", 1)), int(held.notes.get("run", 1)))


def keyed_lookup(wanted: DataFrame, keyed: KeyedFrames, columns: Callable[[DataFrame], DataFrame] = lambda f: f) -> DataFrame:
    """The frames of (dataset_id, episode_index, frame_index); the bucket is part of the join, so few keys prune the scan while it runs.

    ``columns`` picks what is wanted of the frames and must keep the key and ``bucket``.
    """
    key = [*EPISODE, "frame_index", "bucket"]
    return wanted.withColumn("bucket", keyed.bucket()).join(columns(keyed.frames), key).drop("bucket")


def touched(wanted: DataFrame, keyed: KeyedFrames) -> KeyedFrames:
    """The same table cut to the buckets that the keys name. At most one number per bucket comes to the driver, and ``buckets``
    bounds those; a micro-batch then plans its scan over their folders alone."""
    found = [r[0] for r in wanted.select(keyed.bucket().alias("bucket")).distinct().collect()]
    return KeyedFrames(keyed.frames.where(F.col("bucket").isin(found)), keyed.buckets, keyed.run)


def keyed_frame_at(requests: DataFrame, episodes: DataFrame, keyed: KeyedFrames) -> DataFrame:
    """``frame_at`` over a keyed table: the requested frame of each episode, clamped into it."""
    sizes = episodes.select(*EPISODE, F.col("frames").alias("_n")).where(F.col("_n") > 0)
    at = F.least(F.greatest(F.col("requested_index"), F.lit(0)), F.col("_n") - 1).cast("long")
    wanted = requests.withColumnRenamed("frame_index", "requested_index").join(sizes, list(EPISODE)).withColumn("frame_index", at)
    return keyed_lookup(wanted.withColumnRenamed("_n", "frames"), keyed)


def keyed_deliveries(
    events: DataFrame, publishers: DataFrame, sessions: DataFrame, keyed: KeyedFrames, source: str
) -> DataFrame:
    """``replay_deliveries`` over a keyed table: one row per accepted event and publisher it reaches, with the frame's positions."""
    accepted = replay_targets(events, sessions).where(F.col("error").isNull() & (F.col("frames") > 0)).drop("error")
    pose = lambda f: positions(f, source).select(*EPISODE, "frame_index", "bucket", "joint_names", "positions")
    return keyed_lookup(accepted, keyed, pose).join(publisher_keys(publishers), ["token"])


def replay_stream(
    events: DataFrame, publishers: DataFrame, sessions: DataFrame, keyed: KeyedFrames, source: str, sink: Callable[[DataFrame, int], None]
):
    """Deliveries of a stream of events: every micro-batch reads the buckets its events point at and no others.

    Returns a writer for the caller to trigger and start; ``sink`` gets the deliveries of each micro-batch.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        here = batch.persist()
        try:
            aimed = replay_targets(here, sessions).where(F.col("error").isNull())
            sink(keyed_deliveries(here, publishers, sessions, touched(aimed, keyed), source), batch_id)
        finally:
            here.unpersist()

    return events.writeStream.foreachBatch(deliver)
