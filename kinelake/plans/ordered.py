"""Aggregates and ordered operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import scalars as X
from kinelake.functions import vectors as V
from kinelake.operators import aggregates as A
from kinelake.operators import joins as J
from kinelake.operators import windows as W
from kinelake.plans.basics import r6
from kinelake.plans.fixtures import STALE_SECONDS
from kinelake.plans.registry import cte, query
from kinelake.sources.journals import assign_episode_index
from kinelake.sources import keyed as K

cte(
    "rec",
    """
SELECT j.* FROM jrn j LEFT JOIN eps e ON e.dataset_id = j.dataset_id AND e.run_id = j.run_id WHERE e.run_id IS NULL""",
    "jrn", "eps",
)
cte(
    "summ",
    """
SELECT ds.dataset_id, coalesce(e.n, 0) AS episode_count, CAST(coalesce(e.f, 0) AS BIGINT) AS total_frames,
       coalesce(e.d, 0) AS duration_seconds, coalesce(r.n, 0) AS incomplete, r.m AS first_incomplete
FROM ds LEFT JOIN (SELECT dataset_id, count(*) AS n, sum(frames) AS f, sum(coalesce(duration_seconds, 0)) AS d FROM eps GROUP BY 1) e
  ON e.dataset_id = ds.dataset_id
LEFT JOIN (SELECT dataset_id, count(*) AS n, min(run_id) AS m FROM rec GROUP BY 1) r ON r.dataset_id = ds.dataset_id""",
    "ds", "eps", "rec",
)


def summaries(t):
    return A.summarize(t.datasets, t.episodes, J.recoverable(t.journals, t.episodes))


@query(
    "A1_summarize",
    "summ",
    sql="""
SELECT dataset_id, episode_count, total_frames, round(duration_seconds, 6) AS duration_seconds, incomplete, first_incomplete,
       'shoulder,elbow,gripper' AS joint_names, 'front,wrist' AS cameras FROM summ""",
)
def a1(t):
    return summaries(t).select(
        "dataset_id", "episode_count", "total_frames", r6(F.col("duration_seconds")).alias("duration_seconds"),
        "incomplete", "first_incomplete", F.concat_ws(",", "joint_names").alias("joint_names"),
        F.concat_ws(",", "cameras").alias("cameras"),
    )


@query(
    "A1_camera_shapes",
    sql="""
SELECT n_name AS dataset_id, c.camera, CAST(coalesce(c.width, 0) AS INTEGER) AS width, CAST(coalesce(c.height, 0) AS INTEGER) AS height,
       CAST(coalesce(nullif(c.channels, 0), 3) AS INTEGER) AS channels
FROM nation, LATERAL (VALUES ('front', 640, 480, n_nationkey % 3), ('wrist', CASE WHEN n_nationkey % 2 = 0 THEN 320 END, NULL, NULL)) AS c(camera, width, height, channels)""",
)
def a1_shapes(t):
    key = F.col("n_nationkey")
    none = F.lit(None).cast("int")
    row = F.array(
        F.struct(F.lit("front").alias("camera"), F.lit(640).alias("width"), F.lit(480).alias("height"),
                 (key % 3).alias("channels")),
        F.struct(F.lit("wrist").alias("camera"), F.when(key % 2 == 0, 320).alias("width"), none.alias("height"),
                 none.alias("channels")),
    )
    return A.camera_shapes(t("nation").select(F.col("n_name").alias("dataset_id"), F.inline(row)))


BAD_MANIFESTS_SQL = "SELECT 'bad-' || s_suppkey AS dataset_id, 'unsupported manifest' AS error FROM supplier WHERE s_acctbal < 500"


def bad_manifests(t):
    return t("supplier").where("s_acctbal < 500").select(
        F.concat(F.lit("bad-"), "s_suppkey").alias("dataset_id"), F.lit("unsupported manifest").alias("error")
    )


@query(
    "A2_catalog",
    "summ",
    sql=f"""
SELECT dataset_id, total_frames, NULL::VARCHAR AS error, (SELECT count(*) FROM summ) AS dataset_count FROM summ
UNION ALL SELECT dataset_id, NULL, error, (SELECT count(*) FROM summ) FROM ({BAD_MANIFESTS_SQL})""",
)
def a2(t):
    return A.catalog(summaries(t), bad_manifests(t)).select("dataset_id", "total_frames", "error", "dataset_count")


@query(
    "A3_summary_report",
    "summ",
    sql="""
SELECT dataset_id, episode_count || ' episode(s), ' || total_frames || ' frames; cameras: front, wrist' AS report FROM summ""",
)
def a3(t):
    return A.summary_report(summaries(t))


@query(
    "A3_report_resolutions",
    "summ",
    sql="""
SELECT dataset_id, episode_count || ' episode(s), ' || total_frames || ' frames; cameras: ' || CASE WHEN CAST(substring(dataset_id, 8) AS BIGINT) % 4 = 3 THEN 'unknown'
       ELSE 'front 640x480x3, wrist 320x' || (200 + CAST(substring(dataset_id, 8) AS BIGINT)) || 'x1' END AS report FROM summ""",
)
def a3_resolutions(t):
    """Reports that name each camera's resolution; some datasets know none."""
    number = F.col("n_nationkey")
    seen = t.datasets.where(number % 4 != 3).select("dataset_id", "n_nationkey", F.explode("cameras").alias("camera"))
    front = F.col("camera") == "front"
    cameras = seen.select(
        "dataset_id", "camera", F.when(front, 640).otherwise(320).alias("width"), F.when(front, 480).otherwise(200 + number).alias("height"),
        F.when(front, F.lit(None)).otherwise(1).alias("channels"),
    )
    return A.summary_report(summaries(t), A.camera_shapes(cameras))


@query(
    "A4_feature_stats",
    "fln",
    sql="""
SELECT joint, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS count
FROM fln, LATERAL (VALUES (0, o0), (1, o1), (2, o2), (3, o3)) AS c(joint, v) GROUP BY joint""",
)
def a4(t):
    stats = A.feature_stats(t.frames_lines, "observation_state")
    return stats.select("joint", *[r6(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")], "count")


@query(
    "A4_feature_stats_wide",
    sql="""
SELECT CAST(i - 1 AS INTEGER) AS joint, round(min(v), 6) + 0.0::DOUBLE AS min, round(max(v), 6) + 0.0::DOUBLE AS max, round(avg(v), 6) + 0.0::DOUBLE AS mean,
       round(stddev_pop(v), 6) AS std, count(*) AS count
FROM (SELECT unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY i""",
)
def a4_wide(t):
    stats = A.feature_stats(t.frames_vec, "observation_state")
    return stats.select("joint", *[r6(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")], "count")


@query(
    "A5_export_totals",
    "fo", "eps",
    sql="""
SELECT f.dataset_id, f.episodes, f.frames, coalesce(m.media, 0) AS media
FROM (SELECT dataset_id, count(DISTINCT episode_index) AS episodes, count(*) AS frames FROM fo GROUP BY 1) f
LEFT JOIN (SELECT dataset_id, CAST(sum(len(cameras)) AS BIGINT) AS media FROM eps GROUP BY 1) m ON m.dataset_id = f.dataset_id""",
)
def a5(t):
    media = t.episodes.select("dataset_id", F.explode("cameras").alias("camera"))
    return A.export_totals(t.frames_orders, media)


@query(
    "A10_tracking_error",
    "fe",
    sql="""
SELECT episode_index, joint, round(max(g), 6) AS max_error
FROM fe, LATERAL (VALUES (0, abs(a0 - o0)), (1, abs(a1 - o1)), (2, abs(a2 - o2))) AS c(joint, g) GROUP BY ALL""",
)
def a10(t):
    return A.tracking_error(t.frames_events).select("episode_index", "joint", r6(F.col("max_error")).alias("max_error"))


JERK_SQL = """
SELECT episode_index, channel, coalesce(sqrt(avg(d * d)), 0) AS jerk
FROM (SELECT episode_index, channel, v - 3 * lag(v, 1) OVER w + 3 * lag(v, 2) OVER w - lag(v, 3) OVER w AS d FROM {src}
      WINDOW w AS (PARTITION BY episode_index, channel, joint ORDER BY frame_index)) GROUP BY ALL"""


@query(
    "A11_jerk_rms",
    "fel",
    sql=f"SELECT episode_index, channel, round(jerk, 6) AS jerk_rms FROM ({JERK_SQL.format(src='fel')})",
)
def a11(t):
    return A.jerk_rms(t.frames_events, ("observation", "action", "leader")).select("episode_index", "channel", r6(F.col("jerk_rms")).alias("jerk_rms"))


@query(
    "A13_bounds",
    "pts",
    sql="""
WITH b AS (SELECT episode_index, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM pts GROUP BY 1),
s AS (SELECT *, greatest(greatest(max_x - min_x, max_y - min_y, max_z - min_z) * 1e-4, 1e-5) AS slack FROM b)
SELECT p.episode_index, frame_index,
       x >= min_x * 0.5 - slack AND y >= min_y * 0.5 - slack AND z >= min_z * 0.5 - slack AND x <= max_x - slack * 2 + slack
       AND y <= max_y - slack * 2 + slack AND z <= max_z - slack * 2 + slack AS inside
FROM pts p JOIN (SELECT episode_index, min_x, min_y, min_z, max_x, max_y, max_z,
                 greatest(greatest(greatest(0, (max_x - slack * 2) - min_x * 0.5), greatest(0, (max_y - slack * 2) - min_y * 0.5),
                          greatest(0, (max_z - slack * 2) - min_z * 0.5)) * 1e-4, 1e-5) AS slack2, slack FROM s) USING (episode_index)""",
)
def a13(t):
    box = A.bounds(t.points)
    # A box shrunk at both ends, so that points fall on either side of it.
    spans = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"])
    slack = F.greatest(spans * 1e-4, F.lit(1e-5))
    box = box.withColumn("slack", slack)
    joined = t.points.join(box, ["dataset_id", "episode_index"])
    outer = {f"min_{a}": F.col(f"min_{a}") * 0.5 for a in "xyz"} | {
        f"max_{a}": F.col(f"max_{a}") - F.col("slack") * 2 for a in "xyz"
    }
    inner = {f"{e}_{a}": F.col(a) for e in ("min", "max") for a in "xyz"}
    return joined.select("episode_index", "frame_index", A.bounds_include(outer, inner).alias("inside"))


@query(
    "A14_lower_median_mad",
    "fel",
    sql="""
WITH m AS (SELECT episode_index, joint, quantile_disc(v, 0.5) AS med FROM fel WHERE channel = 'observation' GROUP BY ALL)
SELECT m.episode_index, m.joint, round(m.med, 6) AS median, round(quantile_disc(abs(v - m.med), 0.5), 6) AS mad
FROM m JOIN fel ON fel.episode_index = m.episode_index AND fel.joint = m.joint AND fel.channel = 'observation'
GROUP BY m.episode_index, m.joint, m.med""",
)
def a14(t):
    values = A.long_form(t.frames_events)
    out = A.mad(values, ["dataset_id", "episode_index", "joint"], "value")
    return out.select("episode_index", "joint", r6(F.col("median")).alias("median"), r6(F.col("mad")).alias("mad"))


@query(
    "A15_percentiles",
    "fln",
    sql="""
SELECT episode_index, round(quantile_cont(o0, 0.01), 6) AS p1, round(quantile_cont(o0, 0.6), 6) AS p60, round(quantile_cont(o0, 0.9), 6) AS p90,
       round(quantile_cont(o0, 0.95), 6) AS p95, round(quantile_cont(o0, 0.99), 6) AS p99, count(*) AS n
FROM (SELECT episode_index, o0 + frame_index * 0.001::DOUBLE AS o0 FROM fln) GROUP BY 1""",
)
def a15(t):
    from kinelake.operators.blocks import exact_quantiles

    value = F.get("observation_state", F.lit(0)).cast("double") + F.col("frame_index") * F.lit(0.001)
    values = t.frames_lines.select("dataset_id", "episode_index", value.alias("v"))
    probs = {"p1": 0.01, "p60": 0.6, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    out = exact_quantiles(values, ["dataset_id", "episode_index"], "v", probs)
    return out.select("episode_index", *[r6(F.col(p)).alias(p) for p in probs], F.col("_n").alias("n"))


# --- capture ------------------------------------------------------------------------------------------------------

cte(
    "tick",
    """
SELECT user_id AS run_id, captured_at_ns, event_id AS sequence,
       CASE WHEN event_type IN ('error', 'signup') THEN event_type || ' failed' END AS error
FROM ev WHERE event_type <> 'view' OR k % 4 <> 0""",
    "ev",
)
cte(
    "ctl",
    """
SELECT user_id AS run_id, captured_at_ns, event_id AS sequence, CASE WHEN k % 8 = 4 THEN 'pause' ELSE 'resume' END AS event
FROM ev WHERE event_type = 'view' AND k % 4 = 0""",
    "ev",
)


def ticks(t):
    control = (F.col("event_type") == "view") & (F.col("k") % 4 == 0)
    base = t.events.select(
        F.col("user_id").alias("run_id"), "captured_at_ns", F.col("event_id").alias("sequence"), "event_type", "k",
        control.alias("_control"),
    )
    failed = F.when(
        F.col("event_type").isin("error", "signup"), F.concat(F.col("event_type"), F.lit(" failed"))
    )
    ticked = base.where(~F.col("_control")).select("run_id", "captured_at_ns", "sequence", failed.alias("error"))
    event = F.when(F.col("k") % 8 == 4, "pause").otherwise("resume")
    return ticked, base.where("_control").select("run_id", "captured_at_ns", "sequence", event.alias("event"))


@query(
    "A16_capture_status",
    "tick",
    sql="""
WITH g AS (SELECT run_id, max(sequence) FILTER (error IS NULL) AS good FROM tick GROUP BY 1)
SELECT tick.run_id, count(*) FILTER (error IS NULL) AS captured, count(*) FILTER (error IS NOT NULL) AS dropped,
       count(*) FILTER (error IS NOT NULL AND (good IS NULL OR sequence > good)) AS consecutive_errors,
       coalesce(arg_max(error, sequence) FILTER (error IS NOT NULL AND (good IS NULL OR sequence > good)), '') AS last_error
FROM tick JOIN g ON g.run_id = tick.run_id GROUP BY 1""",
)
def a16(t):
    return A.capture_status(ticks(t)[0])


@query(
    "A17_trajectory",
    "fe",
    sql="""
SELECT episode_index, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS parts, CAST(0 AS BIGINT) AS first_frame, count(*) AS frames, 'action' AS source,
       array_to_string(list(printf('%.4f/%.4f/%.4f', a0, a1, a2) ORDER BY frame_index), ' ') AS path
FROM fe GROUP BY 1""",
)
def a17(t):
    sizes = A.full_episodes(t.frames_events).select(
        "dataset_id", "episode_index", "frames", F.lit(30).alias("fps"), F.lit("").alias("units")
    )
    payload = A.trajectory_payload(t.frames_events, sizes, "action")
    step = F.transform(
        "trajectory", lambda p: F.format_string("%.4f/%.4f/%.4f", F.get(p, 0), F.get(p, 1), F.get(p, 2))
    )
    return payload.select(
        "episode_index", "part", "parts", "first_frame", "frames", "source", F.concat_ws(" ", step).alias("path")
    )


# --- windows ------------------------------------------------------------------------------------------------------


@query(
    "W1_timeline",
    "smp",
    sql="""
SELECT run_id, sequence, frame_index, round(CAST(CAST(frame_index / 30.0 AS FLOAT) AS DOUBLE), 6) AS timestamp
FROM (SELECT run_id, sequence, row_number() OVER (PARTITION BY run_id ORDER BY captured_at_ns, sequence) - 1 AS frame_index
      FROM smp WHERE armed AND live)""",
)
def w1(t):
    accepted = t.samples.where("armed AND live").select("run_id", "captured_at_ns", "sequence")
    return W.assign_timeline(accepted, F.lit(30)).select(
        "run_id", "sequence", "frame_index", r6(F.col("timestamp").cast("double")).alias("timestamp")
    )


@query(
    "W2_episode_index",
    "rec", "eps",
    sql="""
SELECT rec.dataset_id, run_id, row_number() OVER (PARTITION BY rec.dataset_id ORDER BY started_at, run_id) - 1 + coalesce(n, 0) AS episode_index
FROM rec LEFT JOIN (SELECT dataset_id, count(*) AS n FROM eps GROUP BY 1) e ON e.dataset_id = rec.dataset_id""",
)
def w2(t):
    runs = J.recoverable(t.journals, t.episodes).select("dataset_id", "run_id", "started_at")
    saved = t.episodes.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("saved"))
    return assign_episode_index(runs, saved).select("dataset_id", "run_id", "episode_index")


@query(
    "W3_episode_offsets",
    "eps",
    sql="""
SELECT dataset_id, episode_index, CAST(sum(frames) OVER w - frames AS BIGINT) AS dataset_from_index, CAST(sum(frames) OVER w AS BIGINT) AS dataset_to_index
FROM eps WINDOW w AS (PARTITION BY dataset_id ORDER BY episode_index ROWS UNBOUNDED PRECEDING)""",
)
def w3(t):
    return W.episode_offsets(t.episodes.select("dataset_id", "episode_index", "frames")).select(
        "dataset_id", "episode_index", "dataset_from_index", "dataset_to_index"
    )


@query(
    "W4_arm_velocity",
    "fe",
    sql="""
SELECT episode_index, frame_index, round(sqrt(power(o0 - lag(o0) OVER w, 2) + power(o1 - lag(o1) OVER w, 2)), 6) AS arm_velocity
FROM fe WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)""",
)
def w4(t):
    return W.arm_velocity(t.frames_events, F.lit(2)).select(
        "episode_index", "frame_index", F.round("arm_velocity", 6).alias("arm_velocity")
    )


@query(
    "W5_capture_rate",
    "smp",
    sql="""
SELECT run_id, sequence, round(CASE WHEN count(*) OVER w > 1 AND max(captured_at_ns) OVER w > min(captured_at_ns) OVER w
       THEN (count(*) OVER w - 1) / ((max(captured_at_ns) OVER w - min(captured_at_ns) OVER w) / 1e9) ELSE 0 END, 9) AS capture_rate_hz
FROM smp WINDOW w AS (PARTITION BY run_id ORDER BY captured_at_ns, sequence ROWS 29 PRECEDING)""",
)
def w5(t):
    rates = W.capture_rate(t.samples.select("run_id", "captured_at_ns", "sequence"))
    return rates.select("run_id", "sequence", F.round("capture_rate_hz", 9).alias("capture_rate_hz"))


@query(
    "W6_runs",
    "fe",
    sql="""
SELECT episode_index, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS length
FROM (SELECT episode_index, frame_index, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS island
      FROM fe WHERE o2 <> a2) GROUP BY episode_index, island""",
)
def w6(t):
    differs = F.get("observation_state", F.lit(2)) != F.get("action", F.lit(2))
    marked = t.frames_events.withColumn("mismatch", differs)
    return W.runs(marked, "mismatch").select("episode_index", "first_frame", "last_frame", "length")


@query(
    "W11_not_increasing",
    "fo",
    sql="""
SELECT dataset_id, episode_index, frame_index FROM (SELECT *, lag(timestamp) OVER w >= timestamp AS late FROM fo
       WINDOW w AS (PARTITION BY dataset_id, episode_index ORDER BY frame_index)) WHERE late""",
)
def w11(t):
    return W.not_increasing(t.frames_orders).select("dataset_id", "episode_index", "frame_index")


AUTOPAUSE_SQL = """
WITH u AS (SELECT run_id, sequence, error, NULL AS event FROM tick UNION ALL SELECT run_id, sequence, NULL, event FROM ctl),
f AS (SELECT *, error IS NOT NULL AS fail, sum(CASE WHEN event = 'resume' THEN 1 ELSE 0 END) OVER w AS stretch FROM u
      WINDOW w AS (PARTITION BY run_id ORDER BY sequence)),
g AS (SELECT *, coalesce(fail AND lag(fail, 1) OVER w AND lag(fail, 2) OVER w, FALSE) OR coalesce(event = 'pause', FALSE) AS stop FROM f
      WINDOW w AS (PARTITION BY run_id ORDER BY sequence)),
p AS (SELECT run_id, stretch, min(sequence) AS stop_at FROM g WHERE stop GROUP BY ALL)
SELECT g.run_id, g.sequence, CASE WHEN g.sequence > stop_at THEN 'skipped' WHEN fail THEN 'dropped' ELSE 'captured' END AS outcome{extra}
FROM g LEFT JOIN p ON p.run_id = g.run_id AND p.stretch = g.stretch WHERE event IS NULL"""


@query("W12_autopause", "tick", "ctl", sql=AUTOPAUSE_SQL.format(extra=", coalesce(g.sequence = stop_at, FALSE) AS pauses"))
def w12(t):
    return W.apply_autopause(*ticks(t)).select("run_id", "sequence", "outcome", "pauses")


# --- joins --------------------------------------------------------------------------------------------------------


def _camera_sql(cam: str) -> str:
    age = f"greatest(0, captured_at_ns - {cam}_at)::DOUBLE / 1e9"
    return f"""CASE WHEN {cam}_at IS NULL THEN 'camera {cam} frame too old (no capture time)'
      WHEN {age} > 86400 THEN 'camera {cam} frame too old (' || printf('%.2fs > 86400.00s', {age}) || ')'
      WHEN {cam}_empty THEN 'camera {cam} sent no picture' END"""


cte(
    "sync",
    f"""
SELECT *, coalesce({_camera_sql('front')}, {_camera_sql('wrist')}) AS reason
FROM (SELECT s.*, f.sequence AS front_sequence, f.captured_at_ns AS front_at, f.empty AS front_empty,
             w.sequence AS wrist_sequence, w.captured_at_ns AS wrist_at, w.empty AS wrist_empty
      FROM smp s ASOF LEFT JOIN (SELECT * FROM cam WHERE camera = 'front') f ON s.run_id = f.run_id AND s.captured_at_ns >= f.captured_at_ns
      ASOF LEFT JOIN (SELECT * FROM cam WHERE camera = 'wrist') w ON s.run_id = w.run_id AND s.captured_at_ns >= w.captured_at_ns)""",
    "smp", "cam",
)


def synced(t):
    return J.sync_streams(t.samples, t.camera_frames, ["front", "wrist"], STALE_SECONDS)


@query("J1_sync_streams", "sync", sql="SELECT run_id, sequence, front_sequence, wrist_sequence, reason FROM sync")
def j1(t):
    return synced(t).select(
        "run_id", "sequence", F.col("cameras")["front"]["sequence"].alias("front_sequence"),
        F.col("cameras")["wrist"]["sequence"].alias("wrist_sequence"), "reason",
    )


@query(
    "J3_episode_facts",
    "eps", "ds", "fo",
    sql="""
SELECT e.dataset_id, e.episode_index, e.frames, c.n AS row_count, d.fps AS manifest_fps, d.task AS manifest_task, d.robot_type
FROM eps e LEFT JOIN ds d ON d.dataset_id = e.dataset_id
LEFT JOIN (SELECT dataset_id, episode_index, count(*) AS n FROM fo GROUP BY ALL) c ON c.dataset_id = e.dataset_id AND c.episode_index = e.episode_index""",
)
def j3(t):
    return J.episode_facts(t.datasets, t.episodes, t.frames_orders).select(
        "dataset_id", "episode_index", "frames", "row_count", "manifest_fps", "manifest_task", "robot_type"
    )


@query(
    "J4_recoverable",
    "rec",
    sql="""
SELECT dataset_id, run_id, frames, round(frames::DOUBLE / greatest(1, fps), 6) AS duration_seconds,
       'unfinished run' || CASE WHEN frames = 0 THEN ' without frames, discard' ELSE ', save or discard' END || ' it to record again' AS message
FROM rec""",
)
def j4(t):
    return J.recoverable(t.journals, t.episodes).select(
        "dataset_id", "run_id", "frames", r6(F.col("duration_seconds")).alias("duration_seconds"), "message"
    )


@query(
    "J4_saved_runs",
    "jrn", "eps",
    sql="SELECT dataset_id, run_id, frames FROM jrn WHERE EXISTS (SELECT 1 FROM eps WHERE eps.dataset_id = jrn.dataset_id AND eps.run_id = jrn.run_id)",
)
def j4_saved(t):
    return J.saved_runs(t.journals, t.episodes).select("dataset_id", "run_id", "frames")


REPLAY_SQL = """
WITH e AS (SELECT event_id, substring(sha256('events-demo|' || CASE WHEN k = 7 THEN 100000 ELSE user_id END), 1, 24) AS token, k AS requested_index,
                  CASE WHEN event_type = 'error' THEN 'stop' WHEN event_id % 2 = 0 THEN 'play' ELSE ' SEEK' END AS event FROM ev),
s AS (SELECT substring(sha256('events-demo|' || episode_index), 1, 24) AS token, episode_index, max(n) AS frames FROM fe GROUP BY ALL),
p AS (SELECT publisher_id, unnest(list_distinct([CASE WHEN k = 0 THEN tk ELSE '' END, CASE WHEN k = 1 THEN tk END, CASE WHEN k = 2 THEN tk END])) AS token
      FROM (SELECT episode_index AS publisher_id, token AS tk, episode_index % 3 AS k FROM s WHERE episode_index % 5 <> 0
            UNION ALL SELECT 100000 + episode_index, token, (episode_index + 1) % 3 FROM s WHERE episode_index % 2 = 0)),
r AS (SELECT e.event_id, e.token, e.requested_index, lower(trim(e.event)) AS event, s.episode_index, s.frames,
             CASE WHEN lower(trim(e.event)) NOT IN ('play', 'seek') THEN 'unknown replay event, choose play or seek'
                  WHEN s.frames IS NULL THEN 'selection no longer known' WHEN s.frames <= 0 THEN 'selection holds no frames' END AS error
      FROM e LEFT JOIN s ON s.token = e.token),
q AS (SELECT *, CASE WHEN error IS NULL THEN least(greatest(requested_index, 0), frames - 1) END AS frame_index FROM r),
pp AS (SELECT DISTINCT publisher_id, token FROM p WHERE token <> '')
"""


def replay_tables(t):
    size = A.full_episodes(t.frames_events)
    sessions = size.withColumn("token", X.identity_token(F.col("dataset_id"), F.col("episode_index")))
    k, user = F.col("k"), F.when(F.col("k") == 7, 100000).otherwise(F.col("user_id"))
    event = F.when(F.col("event_type") == "error", "stop").when(F.col("event_id") % 2 == 0, "play").otherwise(" SEEK")
    events = t.events.select(
        "event_id", X.identity_token(F.lit("events-demo"), user).alias("token"), k.alias("frame_index"), event.alias("event")
    )

    def publishers(base, shift, turn):
        kind = (F.col("episode_index") + turn) % 3
        return base.select(
            (F.col("episode_index") + shift).alias("publisher_id"),
            F.when(kind == 0, F.col("token")).otherwise("").alias("token"),
            F.when(kind == 1, F.col("token")).alias("source_token"),
            F.when(kind == 2, F.col("token")).alias("lineage_token"),
            F.lit("replay").alias("mode"),
            (F.col("episode_index") % 5 != 0 if shift == 0 else F.col("episode_index") % 2 == 0).alias("sync"),
        )

    return events, publishers(sessions, 0, 0).unionByName(publishers(sessions, 100000, 1)), sessions


@query(
    "J5_replay_events",
    "ev", "fe",
    sql=REPLAY_SQL + """
SELECT event_id, event, frame_index, error, CASE WHEN error IS NULL THEN (SELECT count(*) FROM pp WHERE pp.token = q.token) ELSE 0 END AS publishers FROM q""",
)
def j5(t):
    return J.replay_events(*replay_tables(t)).select("event_id", "event", "frame_index", "error", "publishers")


@query(
    "J5_replay_deliveries",
    "ev", "fe",
    sql=REPLAY_SQL + """
SELECT q.event_id, pp.publisher_id, q.frame_index, round(fe.a0, 6) AS p0, round(fe.a1, 6) AS p1
FROM q JOIN pp ON pp.token = q.token JOIN fe ON fe.episode_index = q.episode_index AND fe.frame_index = q.frame_index WHERE error IS NULL""",
)
def j5_deliveries(t):
    out = J.replay_deliveries(*replay_tables(t), t.frames_events, "action")
    return out.select(
        "event_id", "publisher_id", "frame_index", r6(F.get("positions", F.lit(0))).alias("p0"),
        r6(F.get("positions", F.lit(1))).alias("p1"),
    )


@query(
    "J5_deliveries_keyed",
    "ev", "fe",
    sql=REPLAY_SQL + """
SELECT q.event_id, pp.publisher_id, q.frame_index, round(fe.a0, 6) AS p0, round(fe.a1, 6) AS p1
FROM q JOIN pp ON pp.token = q.token JOIN fe ON fe.episode_index = q.episode_index AND fe.frame_index = q.frame_index WHERE error IS NULL""",
)
def j5_keyed(t):
    out = K.keyed_deliveries(*replay_tables(t), t.keyed_events, "action")
    return out.select(
        "event_id", "publisher_id", "frame_index", r6(F.get("positions", F.lit(0))).alias("p0"),
        r6(F.get("positions", F.lit(1))).alias("p1"),
    )


def mapping(t):
    """Joint mappings with a gain that comes from the regions; the gripper has none."""
    region = t("region").agg(F.count("*").cast("double").alias("regions"))
    rows = F.array(
        F.struct(F.lit("shoulder").alias("joint"), F.lit("rig.rotateX").alias("target"), (F.col("regions") - 3.0).alias("scale"),
                 F.lit(0.5).alias("offset"), F.lit(-1.0).alias("sign"), F.lit("dof_a").alias("dof")),
        F.struct(F.lit("elbow").alias("joint"), F.lit("rig.lift").alias("target"), F.lit(None).cast("double").alias("scale"),
                 F.lit(-0.25).alias("offset"), F.lit(None).cast("double").alias("sign"), F.lit("").alias("dof")),
    )
    return region.select(F.inline(rows))


def calibration(t):
    rows = F.array(
        F.struct(F.lit("shoulder").alias("joint"), F.lit(True).alias("calibrated"), (F.col("regions") / 4).alias("sim_home"),
                 F.lit(None).cast("double").alias("dataset_home")),
        F.struct(F.lit("gripper").alias("joint"), F.lit(True).alias("calibrated"), F.lit(0.1).alias("sim_home"),
                 F.lit(0.05).alias("dataset_home")),
        F.struct(F.lit("elbow").alias("joint"), F.lit(False).alias("calibrated"), F.lit(9.0).alias("sim_home"),
                 F.lit(9.0).alias("dataset_home")),
    )
    return t("region").agg(F.count("*").cast("double").alias("regions")).select(F.inline(rows))


@query(
    "J6_retarget",
    "fe",
    sql="""
WITH r AS (SELECT count(*)::DOUBLE AS regions FROM region)
SELECT episode_index, frame_index, joint, target, round(CASE WHEN target = 'rig.rotateX' THEN degrees(v * s + o) ELSE v * s + o END, 6) + 0.0::DOUBLE AS output
FROM fe, r, LATERAL (VALUES ('shoulder', 'rig.rotateX', a0, regions - 3, 0.5::DOUBLE), ('elbow', 'rig.lift', a1, 1.0::DOUBLE, -0.25::DOUBLE)) AS c(joint, target, v, s, o)""",
)
def j6(t):
    return J.retarget(t.frames_events, mapping(t)).select(
        "episode_index", "frame_index", "joint", "target", r6(F.col("output")).alias("output")
    )


@query(
    "J7_retarget_home",
    "fe",
    sql="""
WITH h AS (SELECT episode_index, a0 AS home FROM fe WHERE frame_index = 0), r AS (SELECT count(*)::DOUBLE AS regions FROM region)
SELECT fe.episode_index, frame_index, joint, dof, round(v, 6) + 0.0::DOUBLE AS output
FROM fe JOIN h ON h.episode_index = fe.episode_index, r, LATERAL (VALUES ('shoulder', 'dof_a', regions / 4 - (regions - 3) * (a0 - home)), ('elbow', 'elbow', a1),
     ('gripper', 'gripper', 0.1::DOUBLE + (a2 - 0.05::DOUBLE))) AS c(joint, dof, v)""",
)
def j7(t):
    named = F.array(*[F.lit(d) for d in ("dof_a", "elbow", "gripper")])
    dofs = t("region").select(F.explode(F.concat(named, F.array(F.concat(F.lit("unused-"), "r_regionkey")))).alias("dof")).distinct()
    return J.retarget_home(t.frames_events, mapping(t), calibration(t), dofs).select(
        "episode_index", "frame_index", "joint", "dof", r6(F.col("output")).alias("output")
    )


@query(
    "U4_mapping_arguments",
    "fe",
    sql="""
WITH m AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'shoulder' ELSE 'gripper' END AS joint, 'axis-' || max(s_nationkey) AS target, count(*) / 8.0::DOUBLE AS s FROM supplier GROUP BY 1)
SELECT episode_index, frame_index, m.joint, target, round(v * s, 6) + 0.0::DOUBLE AS output
FROM fe JOIN m ON true, LATERAL (VALUES ('shoulder', o0), ('gripper', o2)) AS j(joint, v) WHERE j.joint = m.joint""",
)
def u4(t):
    """A mapping the caller supplies as a table, here gathered from all suppliers."""
    joint = F.when(F.col("s_suppkey") % 2 == 0, "shoulder").otherwise("gripper")
    given = t("supplier").groupBy(joint.alias("joint")).agg(
        F.concat(F.lit("axis-"), F.max("s_nationkey")).alias("target"), (F.count("*") / 8.0).alias("scale"), F.lit(0.0).alias("offset")
    )
    out = J.retarget(t.frames_events, given, "observation", "degrees")
    return out.select("episode_index", "frame_index", "joint", "target", r6(F.col("output")).alias("output"))


@query(
    "J8_reorder",
    "fe",
    sql="SELECT episode_index, frame_index, round(a2, 6) AS q0, 0.0::DOUBLE AS q1, round(a0, 6) AS q2 FROM fe",
)
def j8(t):
    out = J.reorder(t.frames_events, ["gripper", "wrist", "shoulder"])
    return out.select(
        "episode_index", "frame_index", *[r6(F.get("ordered", F.lit(i))).alias(f"q{i}") for i in range(3)]
    )


@query(
    "J9_policy_error",
    "fe",
    sql="""
SELECT episode_index, frame_index, round(abs(o0 - a0), 6) AS e0, round(abs(o1 - a1), 6) AS e1, round(abs(o2 - a2), 6) AS e2 FROM fe""",
)
def j9(t):
    predicted = t.frames_events.select(
        "dataset_id", "episode_index", "frame_index", V.widen(F.col("observation_state")).alias("prediction")
    )
    out = J.policy_error(predicted, t.frames_events)
    return out.select(
        "episode_index", "frame_index", *[r6(F.get("absolute_error", F.lit(i))).alias(f"e{i}") for i in range(3)]
    )


@query(
    "J10_frames_in_segments",
    "fe",
    sql="""
WITH g AS (SELECT episode_index, min(frame_index) AS first_frame, max(frame_index) + 1 AS end_frame
           FROM (SELECT episode_index, frame_index, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS island FROM fe WHERE o2 > 0.5)
           GROUP BY episode_index, island)
SELECT fe.episode_index, fe.frame_index, g.first_frame AS start_frame, g.end_frame, 'open' AS tag
FROM fe JOIN g ON g.episode_index = fe.episode_index AND fe.frame_index >= g.first_frame AND fe.frame_index < g.end_frame WHERE fe.o2 <> fe.a2""",
)
def j10(t):
    grip, cmd = F.get("observation_state", F.lit(2)), F.get("action", F.lit(2))
    opened = W.runs(t.frames_events.withColumn("m", grip > 0.5), "m")
    segments = opened.select(
        "dataset_id", "episode_index", F.col("first_frame").alias("start_frame"),
        (F.col("last_frame") + 1).alias("end_frame"), F.lit("open").alias("tag"),
    )
    marks = t.frames_events.where(grip != cmd).select("dataset_id", "episode_index", "frame_index")
    return J.frames_in_segments(marks, segments).drop("dataset_id")


@query(
    "T11_recover",
    "jrn", "rec",
    sql="""
WITH a AS (SELECT dataset_id, run_id, CASE CAST(substring(run_id, 5) AS BIGINT) % 150 WHEN 0 THEN 'save' WHEN 50 THEN ' Discard' ELSE 'keep' END AS action
           FROM jrn)
SELECT a.dataset_id, a.run_id, CASE WHEN lower(trim(action)) NOT IN ('save', 'discard') THEN 'unknown action, choose save, finalize or discard'
       WHEN rec.run_id IS NULL THEN 'no such unfinished episode' WHEN lower(trim(action)) = 'discard' THEN 'discarded'
       WHEN rec.frames = 0 THEN 'episode without frames not saved' ELSE 'saved' END AS status
FROM a LEFT JOIN rec ON rec.dataset_id = a.dataset_id AND rec.run_id = a.run_id""",
)
def t11(t):
    key = F.substring("run_id", 5, 20).cast("long") % 150
    action = F.when(key == 0, "save").when(key == 50, " Discard").otherwise("keep")
    actions = t.journals.select("dataset_id", "run_id", action.alias("action"))
    return J.recover(t.journals, t.episodes, actions).select("dataset_id", "run_id", "status")
