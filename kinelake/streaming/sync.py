"""Stateful synchronisation: each sample with the latest frame of every camera, one row per sample, numbered while it streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinelake.operators.joins import camera_reason
from kinelake.operators.projections import STALE_AFTER_FLOOR, validate_samples
from kinelake.streaming.operators import event_time

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Sides of the merged stream, in the order in which rows of the same time apply.
CAMERA, SAMPLE, END = 0, 1, 2
#: State of a run goes when event time has passed its last row by this much.
IDLE_MS = 24 * 3600 * 1000
#: Groups of runs whose state is kept together.
BUCKETS = 256


def merged_stream(samples: DataFrame, cameras: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Samples, camera frames and ends of runs as one stream of slim rows; rows without a run or a time take no part.

    ``ends`` (``run_id, captured_at_ns``): a run that has ended waits for nothing more. ``sequence`` numbers a camera's frames
    and a run's samples.
    """
    none = lambda kind: F.lit(None).cast(kind)
    key = ["run_id", F.col("captured_at_ns").cast("long").alias("captured_at_ns")]
    parts = [
        samples.select(F.lit(SAMPLE).alias("side"), *key, "sequence", none("string").alias("camera"), none("boolean").alias("empty")),
        cameras.select(F.lit(CAMERA).alias("side"), *key, "sequence", "camera", "empty"),
    ]
    if ends is not None:
        parts.append(ends.select(F.lit(END).alias("side"), *key, none("bigint").alias("sequence"), none("string").alias("camera"), none("boolean").alias("empty")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.where(F.col("run_id").isNotNull() & F.col("captured_at_ns").isNotNull() & ((F.col("side") != CAMERA) | F.col("camera").isNotNull()))


#: What waits of a row, and what is kept of a run beside its cameras.
ROW = ["run_id", "side", "captured_at_ns", "sequence", "numbered", "camera", "empty"]
RUN = {"frames": np.int64, "last": np.int64}
STAMP = {"sequence": np.int64, "numbered": bool, "at": np.int64, "seen": bool, "empty": bool}


def packed(table: pd.DataFrame) -> bytes:
    data = pa.Table.from_pandas(table, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema) as writer:
        writer.write_table(data)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class Synchroniser:
    """Per run: the latest frame of each camera, rows that event time has not passed yet, and how many frames were recorded.

    A row waits until the watermark has passed its time, as a camera frame before it may still come. Then rows apply in the order
    of time: a camera frame becomes its camera's latest, a sample leaves with the latest of each. A timeout wakes a bucket whose
    rows have waited long enough; a run that stays idle is forgotten. The runs of a bucket are one group of state and are followed
    together: a micro-batch holds few rows of very many runs, where calls per run cost more than the work on them.
    """

    def __init__(self, names: Sequence[str], stale_after: float):
        self.names, self.limit = list(names), stale_after
        self.known = {**RUN, **{f"{part}_{i}": kind for i in range(len(self.names)) for part, kind in STAMP.items()}}

    def fields(self) -> list[tuple[str, str]]:
        """Columns of a sample that leaves; flags say which numbers are there."""
        kinds = {np.int64: "bigint", bool: "boolean"}
        cameras = [(f"_{part}_{i}", kinds[kind]) for i in range(len(self.names)) for part, kind in STAMP.items()]
        return [("sequence", "bigint"), ("numbered", "boolean"), ("captured_at_ns", "bigint"), ("frame_index", "bigint"), *cameras]

    def follow(self, key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held, known = (unpacked(x) for x in state.get) if state.exists else (None, None)
        parts = ([] if held is None else [held]) + ([] if state.hasTimedOut else [c[ROW] for c in chunks])
        rows = pd.concat([p for p in parts if len(p)], ignore_index=True) if any(map(len, parts)) else pd.DataFrame(columns=ROW)
        before = 0 if known is None else len(known)
        # Runs that are known come first, as they are told apart by their first appearance.
        run, runs = pd.factorize(rows["run_id"] if known is None else pd.concat([known["run_id"], rows["run_id"]], ignore_index=True))
        run = run[before:]
        facts = {n: np.zeros(len(runs), kind) for n, kind in self.known.items()}
        for n in facts if before else ():
            facts[n][:before] = known[n].to_numpy()
        side, at = rows["side"].to_numpy(np.int64), rows["captured_at_ns"].to_numpy(np.int64)
        ended = np.zeros(len(runs), bool)
        ended[run[side == END]] = True
        mine = side != END
        np.maximum.at(facts["last"], run[mine], at[mine])
        due = mine & (ended[run] | (at <= watermark * 1_000_000))
        out = self.apply(rows[due], run[due], runs, facts)
        wait = mine & ~due
        idle = facts["last"] // 1_000_000 + IDLE_MS
        kept = idle > watermark
        if wait.any() or kept.any():
            state.update((packed(rows[wait]), packed(pd.DataFrame({"run_id": runs[kept], **{n: v[kept] for n, v in facts.items()}}))))
            wake = np.concatenate([-(-at[wait] // 1_000_000), idle[kept]]).min()
            # A timeout is over when the watermark lies behind it, a row is due when the watermark reaches it.
            state.setTimeoutTimestamp(max(int(wake) - 1, watermark, 1))
        elif state.exists:
            state.remove()
        if out is not None:
            yield out

    def apply(self, rows: pd.DataFrame, run: np.ndarray, runs, facts: dict[str, np.ndarray]) -> pd.DataFrame | None:
        """Apply rows in the order of time and bring the facts of their runs up to date; one row for each sample among them."""
        if not len(rows):
            return None
        sequence, numbered = rows["sequence"].to_numpy(np.int64), rows["numbered"].to_numpy(bool)
        order = np.lexsort((np.where(numbered, sequence, -1), rows["side"].to_numpy(np.int64), rows["captured_at_ns"].to_numpy(np.int64), run))
        run, sequence, numbered = run[order], sequence[order], numbered[order]
        side, at, camera, empty = (
            rows[n].to_numpy(kind)[order] for n, kind in (("side", np.int64), ("captured_at_ns", np.int64), ("camera", np.int64), ("empty", bool))
        )
        place = np.arange(len(run))
        heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        tails = np.concatenate([heads[1:], [len(run)]]) - 1
        start = np.repeat(heads, tails - heads + 1)
        whole, latest = side == SAMPLE, {}
        for i, name in enumerate(self.names):
            own = (side == CAMERA) & (camera == self.names.index(name))
            newest = np.maximum.accumulate(np.where(own, place, -1))
            here = newest >= start
            values = {"sequence": sequence, "numbered": numbered, "at": at, "seen": own, "empty": empty}
            stamp = {part: np.where(here, v[newest], facts[f"{part}_{i}"][run]) for part, v in values.items()}
            age = np.maximum(0, at - stamp["at"]) / 1e9
            whole &= stamp["seen"] & (stamp["at"] != 0) & (age <= self.limit) & ~stamp["empty"]
            latest |= {f"{part}_{i}": v for part, v in stamp.items()}
        counted = np.cumsum(whole)
        count = facts["frames"][run] + counted - (counted - whole)[start]
        facts["frames"][run[tails]] = count[tails]
        for n, v in latest.items():
            facts[n][run[tails]] = v[tails]
        leaves = side == SAMPLE
        if not leaves.any():
            return None
        return pd.DataFrame({
            "run_id": runs[run[leaves]], "sequence": sequence[leaves], "numbered": numbered[leaves], "captured_at_ns": at[leaves],
            "frame_index": np.where(whole, count - 1, -1)[leaves], **{f"_{n}": v[leaves] for n, v in latest.items()},
        })


def sync_stateful(
    samples: DataFrame, cameras: DataFrame, names: Sequence[str], stale_after: float = 0.5, lateness: str = "10 seconds",
    ends: DataFrame | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Streams to one row per sample, as ``sync_streams`` gives for tables: run_id, captured_at_ns, sequence, cameras, reason, and
    frame_index, which counts the samples of a run that have every named camera.

    A sample leaves when the watermark (``lateness`` behind the newest row) has passed it, or when its run ends; rows later than
    that are dropped by the watermark. State per run: one frame per camera and the rows of the last ``lateness``; that of all runs
    of a bucket is read and written together. ``buckets`` bounds the tasks that work side by side and must stay the same while a
    checkpoint is in use. Sets the session's state store to the one that keeps state out of the executors' heap.
    """
    limit = max(STALE_AFTER_FLOOR, stale_after)
    samples.sparkSession.conf.set(PROVIDER_CONF, PROVIDER)
    named = cameras.where(F.col("camera").isin(*names))
    merged = merged_stream(samples, named, ends).select(
        "run_id", "side", "captured_at_ns", F.coalesce(F.col("sequence").cast("long"), F.lit(0)).alias("sequence"), F.col("sequence").isNotNull().alias("numbered"),
        (F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("camera")), F.lit(0)) - 1).cast("long").alias("camera"),
        F.coalesce("empty", F.lit(False)).alias("empty"), F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"),
    )
    timed = merged.withColumn("event_time", event_time()).withWatermark("event_time", lateness)
    processor = Synchroniser(names, limit)
    kind = samples.schema["run_id"].dataType.simpleString()
    schema = f"run_id {kind}, " + ", ".join(f"{n} {k}" for n, k in processor.fields())
    rows = timed.groupBy("bucket").applyInPandasWithState(
        processor.follow, schema, "waiting binary, known binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return stamped(rows, names, limit)


def stamped(rows: DataFrame, names: Sequence[str], limit: float) -> DataFrame:
    """The flat columns of each camera as the map and the reason that a synchronised table has."""

    def snapshot(i: int) -> Column:
        number = F.when(F.col(f"_numbered_{i}"), F.col(f"_sequence_{i}"))
        body = F.struct(number.alias("sequence"), F.col(f"_at_{i}").alias("captured_at_ns"), F.col(f"_empty_{i}").alias("empty"))
        return F.when(F.col(f"_seen_{i}"), body)

    seen = {n: snapshot(i) for i, n in enumerate(names)}
    reason = F.coalesce(*[camera_reason(n, s, F.col("captured_at_ns"), limit) for n, s in seen.items()])
    pairs = F.array(*[F.struct(s["sequence"].alias("sequence"), s["captured_at_ns"].alias("captured_at_ns")) for s in seen.values()])
    cameras = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), pairs)
    return rows.select(
        "run_id", "captured_at_ns", F.when(F.col("numbered"), F.col("sequence")).alias("sequence"), cameras.alias("cameras"),
        reason.alias("reason"), F.when(F.col("frame_index") >= 0, F.col("frame_index")).alias("frame_index"),
    )


def record_stateful(
    samples: DataFrame, cameras: DataFrame, names: Sequence[str], now_ns: Column, sink: str, checkpoint: str, fps: Column,
    stale_after: float = 0.5, require_armed: bool = True, lateness: str = "10 seconds", ends: DataFrame | None = None,
):
    """A recorder: valid samples that have every camera go to ``sink`` with their frame number and timestamp, once each.

    The checkpoint holds the state, so a restart goes on where the last batch ended. Returns a writer for the caller to trigger
    and start.
    """
    valid = validate_samples(samples, now_ns, stale_after, require_armed).where(F.col("reason").isNull()).drop("reason")
    frames = sync_stateful(valid, cameras, names, stale_after, lateness, ends).where(F.col("frame_index").isNotNull())
    timed = frames.drop("reason").withColumn("timestamp", F.col("frame_index") / fps.cast("double"))
    return timed.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)

