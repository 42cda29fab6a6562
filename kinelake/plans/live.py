"""Streaming operators, run over the given tables as finite streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import joins as J
from kinelake.plans.exchange import scratch
from kinelake.plans.fixtures import STALE_SECONDS
from kinelake.plans.ordered import AUTOPAUSE_SQL, REPLAY_SQL, replay_tables, ticks
from kinelake.plans.registry import cte, query
from kinelake.sources import keyed as K
from kinelake.sources import streams as S
from kinelake.streaming import operators as O
from kinelake.streaming import sync as Y


#: Rows of a file, about. Every part has the same number of files and the source takes them by age, so a micro-batch is one part.
FILE_ROWS = 20_000


def as_stream(t, df, name: str, by: str | None = None, parts: int = 3):
    """A table as a file stream; with ``by``, as so many micro-batches in the order of that column."""
    path = scratch(t, name)
    if by is None:
        df.write.parquet(path)
    else:
        cuts, rows = df.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)]), F.count(F.lit(1))).first()
        cuts, files = cuts or [], max(1, rows // FILE_ROWS)
        edges = [None, *cuts, None]
        for i, (low, high) in enumerate(zip(edges, edges[1:])):
            inside = (F.lit(True) if low is None else F.col(by) > low) & (F.lit(True) if high is None else F.col(by) <= high)
            # Rows without a value of the order come first.
            part = df.where(F.coalesce(inside, F.lit(i == 0)))
            part.repartition(files).write.mode("append").parquet(path)
    reader = t.spark.readStream.schema(t.spark.read.parquet(path).schema)
    return (reader if by is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def drain(t, stream, name: str, mode: str = "append"):
    """Run a stream over everything there is and return what its batches wrote."""
    path = scratch(t, name)

    def keep(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(path)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(t, f"{name}-checkpoint"))
    writer.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path)


def sample_messages(t):
    """Samples as JSON texts in the order of time; some messages are of another kind or broken."""
    seq = F.col("sequence")
    body = F.to_json(
        F.struct(
            F.when(seq % 19 == 0, "other").otherwise(F.col("kind")).alias("kind"), "sequence", "captured_at_ns", "joint_names",
            "leader", "observation", "action", "units", "armed", "live",
        )
    )
    text = F.when(seq % 23 == 0, F.concat(F.lit("#"), body)).otherwise(body)
    return t.samples.select("run_id", text.alias("value"), "captured_at_ns")


@query(
    "S4_sample_stream",
    "smp",
    sql="""
SELECT run_id, sequence, row_number() OVER (PARTITION BY run_id ORDER BY captured_at_ns, sequence) - 1 AS frame_index, round(captured_at_ns::DOUBLE / 1e9, 3) AS timestamp
FROM smp WHERE sequence % 19 <> 0 AND sequence % 23 <> 0""",
)
def s4(t):
    parsed = S.parse_samples(as_stream(t, sample_messages(t), "messages", "captured_at_ns").drop("captured_at_ns"))
    numbered = drain(t, O.number_frames(S.stream_frames(parsed)), "stream-frames")
    return numbered.select("run_id", "sequence", "frame_index", F.round("timestamp", 3).alias("timestamp"))


@query(
    "S5_camera_stream",
    "cam",
    sql="""
SELECT run_id, camera, sequence, captured_at_ns, empty, CASE WHEN sequence % 2 = 0 THEN '60.0' END AS fov_horizontal, CAST(CASE WHEN sequence % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS keys FROM cam""",
)
def s5(t):
    file = F.format_string("frame-%d.jpg", F.col("sequence"))
    content = F.when(F.col("empty"), F.lit("")).otherwise(F.lit("jpeg")).cast("binary")
    payloads = t.camera_frames.select(F.concat(F.lit("/camera/"), file).alias("path"), content.alias("content"))
    fields = {k: F.lit(None).cast("string") for k in S.CAMERA_OPTIONAL}
    fields["fov_horizontal"] = F.when(F.col("sequence") % 2 == 0, "60.0")
    side = t.camera_frames.withColumn("file", file).withColumns(fields).drop("empty")
    joined = drain(t, S.attach_sidecars(as_stream(t, payloads, "payloads"), side), "cameras")
    return joined.select(
        "run_id", "camera", "sequence", "captured_at_ns", "empty", F.col("calibration")["fov_horizontal"].alias("fov_horizontal"),
        F.size("calibration").alias("keys"),
    )


@query(
    "S5_late_sidecars",
    "cam",
    sql="""
SELECT CASE WHEN sequence % 11 <> 0 THEN run_id END AS run_id, CASE WHEN sequence % 11 <> 0 THEN camera END AS camera, sequence AS file, CASE WHEN sequence % 11 <> 0 THEN captured_at_ns ELSE 0 END AS captured_at_ns,
       empty, sequence % 11 <> 0 AS described, CAST(CASE WHEN sequence % 2 = 0 AND sequence % 11 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS keys FROM cam""",
)
def s5_late(t):
    """Files and sidecars as two streams: every fifth sidecar comes three days after its file, every eleventh never."""
    seen = F.timestamp_micros((F.col("captured_at_ns") / 1000).cast("long"))
    frames = t.camera_frames
    # A file and a sidecar far behind all others let event time pass them.
    last = frames.agg(F.max("captured_at_ns").alias("captured_at_ns")).select((F.col("captured_at_ns") + 100 * 86_400_000_000_000).alias("captured_at_ns"))
    closing = last.select(F.lit(-1).cast("long").alias("sequence"), "captured_at_ns", F.lit(False).alias("empty"))
    frames = frames.unionByName(closing, allowMissingColumns=True)
    file = F.format_string("frame-%d.jpg", F.col("sequence"))
    payloads = frames.select(
        F.concat(F.lit("/camera/"), file).alias("path"), seen.alias("modificationTime"),
        F.when(F.col("empty"), F.lit("")).otherwise(F.lit("jpeg")).cast("binary").alias("content"), "captured_at_ns",
    )
    fields = {k: F.lit(None).cast("string") for k in S.CAMERA_OPTIONAL}
    fields["fov_horizontal"] = F.when(F.col("sequence") % 2 == 0, "60.0")
    arrives = F.col("captured_at_ns") + F.when(F.col("sequence") % 5 == 0, 3 * 86_400_000_000_000).otherwise(0)
    sides = frames.where(F.col("sequence") % 11 != 0).withColumn("file", file).withColumns(fields).drop("empty")
    sides = as_stream(t, sides.withColumn("written_at", seen).withColumn("arrives", arrives), "sidecars", "arrives").drop("arrives")
    joined = drain(t, S.attach_late_sidecars(as_stream(t, payloads, "files", "captured_at_ns").drop("captured_at_ns"), sides, "40 days"), "described")
    number = F.regexp_extract("path", "frame-(-?[0-9]+)", 1).cast("long")
    return joined.where(F.coalesce(number, F.lit(0)) >= 0).select(
        "run_id", "camera", number.alias("file"), "captured_at_ns", "empty", "described", F.size("calibration").alias("keys")
    )


cte(
    "near",
    """
SELECT run_id, sequence, captured_at_ns, camera, camera_at, camera_sequence FROM (
  SELECT s.run_id, s.sequence, s.captured_at_ns, c.camera, last(c.captured_at_ns ORDER BY c.captured_at_ns, c.sequence) AS camera_at,
         last(c.sequence ORDER BY c.captured_at_ns, c.sequence) AS camera_sequence, last(c.empty ORDER BY c.captured_at_ns, c.sequence) AS empty
  FROM smp s JOIN cam c ON c.run_id = s.run_id AND c.captured_at_ns <= s.captured_at_ns AND c.captured_at_ns >= s.captured_at_ns - 86400000000000
  GROUP BY s.run_id, s.sequence, s.captured_at_ns, c.camera) WHERE NOT empty""",
    "smp", "cam",
)


def recorded_pairs(t):
    samples = as_stream(t, t.samples.select("run_id", "sequence", "captured_at_ns"), "samples", "captured_at_ns")
    cameras = as_stream(t, t.camera_frames, "camera-frames", "captured_at_ns")
    return drain(t, O.sync_pairs(samples, cameras, STALE_SECONDS, "40 days"), "pairs")


@query("J2_sync_streaming", "near", sql="SELECT run_id, sequence, camera, camera_sequence FROM near")
def j2(t):
    return O.latest_pairs(recorded_pairs(t)).select(
        "run_id", "sequence", "camera", F.col("stamp.sequence").alias("camera_sequence")
    )


@query(
    "T4_require_all_cameras",
    "near",
    sql="SELECT run_id, sequence, max(camera_sequence) FILTER (camera = 'front') AS front_sequence, max(camera_sequence) FILTER (camera = 'wrist') AS wrist_sequence FROM near GROUP BY ALL HAVING count(*) = 2",
)
def t4(t):
    full = O.require_all_cameras(recorded_pairs(t), ["front", "wrist"])
    return full.select(
        "run_id", "sequence", F.col("cameras")["front"]["sequence"].alias("front_sequence"),
        F.col("cameras")["wrist"]["sequence"].alias("wrist_sequence"),
    )


def merged_sides(t):
    """Samples, camera frames and the ends of runs as streams that advance together, in three micro-batches."""
    tagged = lambda df, side: df.withColumn("_side", F.lit(side))
    both = tagged(t.samples, Y.SAMPLE).unionByName(tagged(t.camera_frames, Y.CAMERA), allowMissingColumns=True)
    ends = both.groupBy("run_id").agg((F.max("captured_at_ns") + 1).alias("captured_at_ns"))
    source = as_stream(t, both.unionByName(tagged(ends, Y.END), allowMissingColumns=True), "sides", "captured_at_ns")
    return [source.where(F.col("_side") == side).drop("_side") for side in (Y.SAMPLE, Y.CAMERA, Y.END)]


@query("J2_sync_stateful", "sync", sql="SELECT run_id, sequence, front_sequence, wrist_sequence, reason FROM sync")
def j2_stateful(t):
    """The synchronised table of J1 from streams: one row per sample."""
    samples, cameras, ends = merged_sides(t)
    synced = drain(t, Y.sync_stateful(samples, cameras, ["front", "wrist"], STALE_SECONDS, "1 second", ends), "synced")
    return synced.select(
        "run_id", "sequence", F.col("cameras")["front"]["sequence"].alias("front_sequence"),
        F.col("cameras")["wrist"]["sequence"].alias("wrist_sequence"), "reason",
    )


@query(
    "T3_record_stateful",
    "near", "smp",
    sql="""
SELECT n.run_id, n.sequence, row_number() OVER (PARTITION BY n.run_id ORDER BY n.captured_at_ns, n.sequence) - 1 AS frame_index,
       round((row_number() OVER (PARTITION BY n.run_id ORDER BY n.captured_at_ns, n.sequence) - 1) / 30.0::DOUBLE, 6) AS timestamp, front_sequence, wrist_sequence
FROM (SELECT run_id, sequence, captured_at_ns, max(camera_sequence) FILTER (camera = 'front') AS front_sequence, max(camera_sequence) FILTER (camera = 'wrist') AS wrist_sequence
      FROM near GROUP BY ALL HAVING count(*) = 2) n JOIN smp s ON s.run_id = n.run_id AND s.sequence = n.sequence WHERE s.armed AND s.live""",
)
def t3_stateful(t):
    """The recorder that numbers frames while it streams; nothing but finished frames is stored."""
    samples, cameras, ends = merged_sides(t)
    sink = scratch(t, "recorded-frames")
    writer = Y.record_stateful(
        samples, cameras, ["front", "wrist"], F.col("captured_at_ns"), sink, scratch(t, "record-state"), F.lit(30), STALE_SECONDS, True, "1 second", ends
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(sink).select(
        "run_id", "sequence", "frame_index", F.round("timestamp", 6).alias("timestamp"),
        F.col("cameras")["front"]["sequence"].alias("front_sequence"), F.col("cameras")["wrist"]["sequence"].alias("wrist_sequence"),
    )


@query(
    "T1_tick_sample",
    "smp",
    sql="""
SELECT run_id, captured_at_ns // 3600000000000 AS hour, count(*) AS polled, max(sequence) AS sequence FROM smp GROUP BY ALL""",
)
def t1(t):
    stream = as_stream(t, t.samples.select("run_id", "captured_at_ns", "sequence"), "samples", "captured_at_ns")
    ticked = drain(t, O.tick_sample(stream, 1 / 3600, ["sequence"], "2 hours"), "ticks", "update")
    return O.latest_ticks(ticked).select(
        "run_id", F.floor(F.unix_seconds("tick_start") / 3600).cast("long").alias("hour"), "polled", "sequence"
    )


@query("T2_drop_stale", "fe", sql="SELECT episode_index AS run_id, sample_sequence AS sequence FROM fe WHERE recorded_at_ns - captured_at_ns <= 60000000")
def t2(t):
    stream = as_stream(
        t,
        t.frames_events.select(
            F.col("episode_index").alias("run_id"), F.col("sample_sequence").alias("sequence"), "captured_at_ns", "recorded_at_ns"
        ),
        "arrivals",
    )
    fresh = O.drop_stale(stream, F.col("recorded_at_ns"), 0.06)
    return drain(t, fresh.select("run_id", "sequence"), "fresh").select("run_id", "sequence")


@query(
    "T3_record",
    "near", "smp",
    sql="""
SELECT n.run_id, n.sequence, row_number() OVER (PARTITION BY n.run_id ORDER BY n.captured_at_ns, n.sequence) - 1 AS frame_index
FROM (SELECT run_id, sequence, captured_at_ns FROM near GROUP BY ALL HAVING count(*) = 2) n JOIN smp s ON s.run_id = n.run_id AND s.sequence = n.sequence WHERE s.armed AND s.live""",
)
def t3(t):
    samples = as_stream(t, t.samples, "samples", "captured_at_ns")
    cameras = as_stream(t, t.camera_frames, "camera-frames", "captured_at_ns")
    sink = scratch(t, "recorded")
    writer = O.record(
        samples, cameras, F.col("captured_at_ns"), sink, scratch(t, "record-checkpoint"), STALE_SECONDS, True, "40 days"
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    frames = O.recorded_frames(t.spark.read.parquet(sink), ["front", "wrist"], F.lit(30))
    return frames.select("run_id", "sequence", "frame_index")


@query("T5_run_controller", "tick", "ctl", sql=AUTOPAUSE_SQL.format(extra=""))
def t5(t):
    ticked, controls = ticks(t)
    both = ticked.withColumn("event", F.lit(None).cast("string")).unionByName(
        controls.withColumn("error", F.lit(None).cast("string"))
    )
    out = drain(t, O.run_controller(as_stream(t, both, "control", "captured_at_ns")), "controller")
    return out.select("run_id", "sequence", "outcome")


@query(
    "T6_one_euro_stream",
    "smp",
    sql="""
RECURSIVE WITH l AS (SELECT run_id, sequence, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS i, c.joint, c.v
  FROM smp, LATERAL (VALUES ('shoulder', j0), ('elbow', j1), ('gripper', j2)) AS c(joint, v)),
s AS (SELECT run_id, joint, sequence, v, row_number() OVER (PARTITION BY run_id, joint ORDER BY sequence) AS i FROM l),
e(run_id, joint, sequence, i, x, dx) AS (
  SELECT run_id, joint, sequence, i, v, 0.0::DOUBLE FROM s WHERE i = 1
  UNION ALL
  SELECT run_id, joint, sequence, i, a * v + (1 - a) * x, dxh
  FROM (SELECT *, 1.0 / (1.0 + (1.0 / (2 * pi() * (1.0 + 0.007 * abs(dxh)))) * 30) AS a
        FROM (SELECT s.*, e.x, (1.0 / (1.0 + (1.0 / (2 * pi())) * 30)) * ((s.v - e.x) * 30) + (1 - 1.0 / (1.0 + (1.0 / (2 * pi())) * 30)) * e.dx AS dxh
              FROM e JOIN s ON s.run_id = e.run_id AND s.joint = e.joint AND s.i = e.i + 1)))
SELECT run_id, joint, sequence, round(x, 6) AS smoothed FROM e""",
)
def t6(t):
    stream = as_stream(t, t.samples.select("run_id", "captured_at_ns", "sequence", "action"), "samples", "captured_at_ns")
    out = drain(t, O.one_euro_stream(stream), "one-euro")
    return out.select("run_id", "joint", "sequence", F.round("smoothed", 6).alias("smoothed"))


@query(
    "T8_replay_stream",
    "ev", "fe",
    sql=REPLAY_SQL + """
SELECT q.event_id, pp.publisher_id, q.frame_index FROM q JOIN pp ON pp.token = q.token WHERE error IS NULL""",
)
def t8(t):
    events, publishers, sessions = replay_tables(t)
    live = as_stream(t, events, "replay-events")
    out = drain(t, J.replay_deliveries(live, publishers, sessions, t.frames_events, "action"), "deliveries")
    return out.select("event_id", "publisher_id", "frame_index")


@query(
    "T8_replay_keyed",
    "ev", "fe",
    sql=REPLAY_SQL + """
SELECT q.event_id, pp.publisher_id, q.frame_index, round(fe.a0, 6) AS p0
FROM q JOIN pp ON pp.token = q.token JOIN fe ON fe.episode_index = q.episode_index AND fe.frame_index = q.frame_index WHERE error IS NULL""",
)
def t8_keyed(t):
    """Three micro-batches of events, each of which reads the buckets it needs."""
    events, publishers, sessions = replay_tables(t)
    path = scratch(t, "keyed-deliveries")
    live = as_stream(t, events, "keyed-events", "event_id")
    writer = K.replay_stream(live, publishers, sessions, t.keyed_events, "action", lambda out, _: out.write.mode("append").parquet(path))
    writer.option("checkpointLocation", scratch(t, "keyed-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.parquet(path)
    return out.select("event_id", "publisher_id", "frame_index", F.round(F.get("positions", F.lit(0)), 6).alias("p0"))


@query("T9_latest_only", "smp", sql="SELECT run_id, max(sequence) AS sequence, count(*) - 1 AS dropped, CAST(0 AS BIGINT) AS batch_id FROM smp GROUP BY 1")
def t9(t):
    stream = as_stream(t, t.samples.select("run_id", "sequence", "captured_at_ns"), "samples")
    path = scratch(t, "latest")

    def consume(batch, batch_id):
        O.latest_only(batch, batch_id).write.mode("append").parquet(path)

    writer = stream.writeStream.option("checkpointLocation", scratch(t, "latest-checkpoint"))
    writer.foreachBatch(consume).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path).select("run_id", "sequence", "dropped", "batch_id")


@query(
    "T10_publish_live",
    "smp",
    sql="""
SELECT run_id, CASE WHEN bad THEN NULL ELSE sequence END AS sequence, CASE WHEN bad THEN 'unexpected kind, wanted teleoperation sample' END AS error,
       CASE WHEN NOT bad THEN round(j1, 4) END AS elbow
FROM (SELECT *, sequence % 19 = 0 OR sequence % 23 = 0 AS bad FROM smp)""",
)
def t10(t):
    parsed = S.parse_samples(as_stream(t, sample_messages(t), "messages", "captured_at_ns").drop("captured_at_ns"))
    out = drain(t, O.publish_live(parsed, "observation"), "wire")
    pose = F.from_json("value", "positions array<double>")
    return out.select(
        "run_id", F.when(F.col("error").isNull(), F.col("sequence")).alias("sequence"), "error",
        F.round(F.get(pose["positions"], F.lit(1)), 4).alias("elbow"),
    )
