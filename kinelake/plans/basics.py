"""Scalar functions, projections, lookups and de-duplication over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import scalars as X
from kinelake.functions import vectors as V
from kinelake.operators import projections as P
from kinelake.operators.aggregates import full_episodes
from kinelake.plans.registry import query
from kinelake.schema import KIND_CAMERA_STREAM, KIND_REPLAY, KIND_SAMPLE_STREAM
from kinelake.sources import keyed as K

NOW_NS = 1_705_363_200_000_000_000  # 2024-01-16, the middle of the event stream
AGE_LIMIT = 864_000.0


def r6(col):
    return F.round(col, 6) + F.lit(0.0)


# --- scalar functions ---------------------------------------------------------------------------------------------


@query(
    "X1_slug",
    sql="""
SELECT c_custkey, raw, CASE WHEN s = '' THEN NULL ELSE s END AS slug
FROM (SELECT c_custkey, raw, trim(regexp_replace(trim(raw), '[^a-zA-Z0-9._-]+', '-', 'g'), '-._') AS s
      FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '--' ELSE ' ' || c_name || ' / ' || c_mktsegment || '!' END AS raw
            FROM customer))""",
)
def x1(t):
    raw = F.when(F.col("c_custkey") % 10 == 0, "--").otherwise(
        F.concat(F.lit(" "), "c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))
    )
    return t("customer").select("c_custkey", raw.alias("raw"), X.slug(raw).alias("slug"))


@query(
    "X2_identity_token",
    sql="""
SELECT o_orderkey, substring(sha256(o_orderkey || '|' || o_custkey || '|' || o_orderpriority), 1, 24) AS token FROM orders""",
)
def x2(t):
    token = X.identity_token(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", token.alias("token"))


@query(
    "X3_padded_paths",
    sql="""
SELECT o_orderkey, 'episodes/episode-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS episode_path,
       'file-' || lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(3, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0') || '.parquet' AS file_name
FROM orders""",
)
def x3(t):
    return t("orders").select(
        "o_orderkey",
        X.episode_path(F.col("o_orderkey")).alias("episode_path"),
        X.padded("file-", F.col("o_custkey"), 3, ".parquet").alias("file_name"),
    )


@query(
    "X4_to_degrees",
    "fo", "ds",
    sql="""
SELECT fo.dataset_id, episode_index, frame_index,
       round(CASE WHEN units = 'radians' THEN degrees(o0) ELSE o0 END, 6) AS shown
FROM fo JOIN ds USING (dataset_id)""",
)
def x4(t):
    units = t.datasets.select("dataset_id", "units")
    value = F.get("observation_state", F.lit(0)).cast("double")
    return t.frames_orders.join(units, "dataset_id").select(
        "dataset_id", "episode_index", "frame_index", r6(X.to_degrees(value, F.col("units"))).alias("shown")
    )


@query("X5_clamp", sql="SELECT event_id, least(greatest(value, 5), 250) AS clamped FROM events")
def x5(t):
    return t("events").select("event_id", X.clamp(F.col("value"), F.lit(5.0), F.lit(250.0)).alias("clamped"))


@query(
    "X6_first_present",
    "eps", "ds",
    sql="""
SELECT e.dataset_id, e.episode_index, coalesce(nullif(trim(e.task), ''), nullif(trim(d.task), '')) AS task,
       coalesce(nullif(e.duration_seconds, 0), nullif(e.frames, 0)::DOUBLE) AS size_hint
FROM eps e JOIN ds d USING (dataset_id)""",
)
def x6(t):
    manifest = t.datasets.select("dataset_id", F.col("task").alias("manifest_task"))
    return t.episodes.join(manifest, "dataset_id").select(
        "dataset_id",
        "episode_index",
        X.first_present(F.col("task"), F.col("manifest_task")).alias("task"),
        X.first_nonzero(F.col("duration_seconds"), F.col("frames").cast("double")).alias("size_hint"),
    )


@query("X7_iso_utc", sql="SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def x7(t):
    return t("events").select("event_id", X.iso_utc(F.col("ts").cast("timestamp")).alias("iso"))


@query(
    "X8_ns_seconds",
    sql="""
SELECT event_id, epoch_us(ts) * 1000 AS ns, round((epoch_us(ts) * 1000)::DOUBLE / 1e9, 6) AS seconds FROM events""",
)
def x8(t):
    ns = X.timestamp_to_ns(F.col("ts"))
    return t("events").select("event_id", ns.alias("ns"), r6(X.ns_to_seconds(ns)).alias("seconds"))


@query(
    "X9_duration",
    "jrn",
    sql="""
SELECT dataset_id, run_id, round(frames::DOUBLE / greatest(fps, 1), 6) AS duration_seconds FROM jrn""",
)
def x9(t):
    return t.journals.select(
        "dataset_id", "run_id", r6(X.duration_seconds(F.col("frames"), F.col("fps"))).alias("duration_seconds")
    )


@query(
    "X10_vectors",
    "fv",
    sql="""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
       CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax,
       round(abs(embedding[1]::DOUBLE - embedding[2]::DOUBLE), 6) AS first_gap
FROM fv""",
)
def x10(t):
    e = F.col("observation_state")
    gap = V.vec_absdiff(F.slice(e, 1, 1), F.slice(e, 2, 1))
    return t.frames_vec.select(
        "vec_id",
        r6(V.vec_norm(e)).alias("norm"),
        V.vec_argmax(e).alias("argmax"),
        r6(F.get(gap, F.lit(0))).alias("first_gap"),
    )


@query(
    "X11_flag",
    sql="""
SELECT event_id, raw, CASE WHEN raw IS NULL THEN TRUE ELSE lower(trim(raw)) NOT IN ('false', '0', 'no', 'off', '') END AS flag
FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN ' False ' WHEN 2 THEN '0' WHEN 3 THEN 'NO'
             WHEN 4 THEN 'off' WHEN 5 THEN ' ' ELSE event_type END AS raw FROM events)""",
)
def x11(t):
    m = F.col("event_id") % 8
    raw = (
        F.when(m == 0, F.lit(None).cast("string")).when(m == 1, " False ").when(m == 2, "0").when(m == 3, "NO")
        .when(m == 4, "off").when(m == 5, " ").otherwise(F.col("event_type"))
    )
    return t("events").select("event_id", raw.alias("raw"), X.flag(raw, True).alias("flag"))


@query(
    "X12_frame_json",
    "fe",
    sql="""
SELECT episode_index, frame_index, TRUE AS same_index, round(o0, 6) AS shoulder, task, length(task) > 0 AND captured_at_ns > 0 AS has_clock FROM fe""",
)
def x12(t):
    from kinelake.sources.journals import frame_from_json, frame_to_json

    records = P.frame_records(t.frames_events)
    text = records.select("episode_index", "frame_index", frame_to_json(records).alias("line"))
    back = text.withColumn("frame", frame_from_json(F.col("line")))
    return back.select(
        "episode_index", "frame_index",
        (F.col("frame.frame_index") == F.col("frame_index")).alias("same_index"),
        r6(F.col("frame.robot.observation")["shoulder"]).alias("shoulder"), F.col("frame.task").alias("task"),
        (F.col("frame.robot.captured_at_ns") > 0).alias("has_clock"),
    )


@query(
    "X13_camera_field",
    "cam",
    sql="""
SELECT sequence, camera, 'meta.' || CASE WHEN empty THEN 'sequence' ELSE 'captured_at_ns' END AS field FROM cam""",
)
def x13(t):
    field = F.when(F.col("empty"), "sequence").otherwise("captured_at_ns")
    name = F.concat(F.lit("camera."), "camera", F.lit(".meta."), field)
    return t.camera_frames.select("sequence", X.camera_field(name).alias("_p")).select(
        "sequence", F.col("_p.camera").alias("camera"), F.col("_p.field").alias("field")
    )


# --- projections --------------------------------------------------------------------------------------------------

STALE_SQL = """
CASE WHEN captured_at_ns = 0 THEN 'no capture time'
     ELSE printf('%.2fs > 864000.00s', greatest(0, 1705363200000000000 - captured_at_ns)::DOUBLE / 1e9) END"""


@query(
    "P1_validate_samples",
    "smp",
    sql=f"""
SELECT sequence, CASE WHEN sequence % 23 = 0 THEN 'unexpected kind, wanted episode.teleoperation-sample'
  WHEN captured_at_ns = 0 OR greatest(0, 1705363200000000000 - captured_at_ns)::DOUBLE / 1e9 > 864000
       THEN 'robot sample too old (' || {STALE_SQL} || ')'
  WHEN NOT armed THEN 'robot not armed'
  WHEN NOT live THEN 'robot not live'
  WHEN sequence % 29 = 0 THEN 'observed joints missing or out of order'
  WHEN sequence % 31 = 0 THEN 'action lacks a listed joint' END AS reason
FROM (SELECT * REPLACE (CASE WHEN sequence % 37 = 0 THEN 0 ELSE captured_at_ns END AS captured_at_ns) FROM smp)""",
)
def p1(t):
    seq = F.col("sequence")
    none = F.create_map().cast("map<string,double>")
    broken = t.samples.withColumns(
        {
            "kind": F.when(seq % 23 == 0, "other").otherwise(F.col("kind")),
            "captured_at_ns": F.when(seq % 37 == 0, 0).otherwise(F.col("captured_at_ns")),
            "observation": F.when(seq % 29 == 0, none).otherwise(F.col("observation")),
            "action": F.when(seq % 31 == 0, none).otherwise(F.col("action")),
        }
    )
    return P.validate_samples(broken, F.lit(NOW_NS), AGE_LIMIT, True).select("sequence", "reason")


@query(
    "P2_age_seconds",
    "smp",
    sql=f"""
SELECT sequence, round(CASE WHEN captured_at_ns = 0 THEN 'inf'::DOUBLE
                  ELSE greatest(0, 1705363200000000000 - captured_at_ns)::DOUBLE / 1e9 END, 6) AS age_seconds,
       CASE WHEN captured_at_ns = 0 THEN TRUE
            ELSE greatest(0, 1705363200000000000 - captured_at_ns)::DOUBLE / 1e9 > 864000 END AS stale,
       {STALE_SQL} AS detail
FROM (SELECT * REPLACE (CASE WHEN sequence % 37 = 0 THEN 0 ELSE captured_at_ns END AS captured_at_ns) FROM smp)""",
)
def p2(t):
    captured = F.when(F.col("sequence") % 37 == 0, 0).otherwise(F.col("captured_at_ns"))
    age = X.age_seconds(F.col("captured_at_ns"), F.lit(NOW_NS))
    return t.samples.withColumn("captured_at_ns", captured).select(
        "sequence",
        F.round(age, 6).alias("age_seconds"),
        (age > AGE_LIMIT).alias("stale"),
        X.stale_detail(F.col("captured_at_ns"), age, AGE_LIMIT).alias("detail"),
    )


@query(
    "P3_all_finite",
    "fe",
    sql="""
SELECT episode_index, frame_index, NOT (k0 IS NULL OR isnan(k0) OR isinf(k0)) AS finite
FROM (SELECT episode_index, frame_index, CASE sample_sequence % 11 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE
             WHEN 2 THEN NULL WHEN 3 THEN '-inf'::DOUBLE ELSE o0 END AS k0 FROM fe)""",
)
def p3(t):
    m = F.col("sample_sequence") % 11
    bad = (
        F.when(m == 0, float("nan")).when(m == 1, float("inf")).when(m == 2, F.lit(None).cast("double"))
        .when(m == 3, float("-inf")).otherwise(F.get("observation_state", F.lit(0)).cast("double"))
    )
    vector = F.array(bad, F.get("observation_state", F.lit(1)).cast("double"))
    return t.frames_events.select("episode_index", "frame_index", V.all_finite(vector).alias("finite"))


@query(
    "P4_positions",
    "fo",
    sql="""
SELECT dataset_id, episode_index, frame_index, round(a0, 6) AS p0, round(a1, 6) AS p1,
       round(CASE WHEN leader_width = 3 THEN a2 ELSE 0 END, 6) AS p2 FROM fo""",
)
def p4(t):
    at = P.positions(t.frames_orders, "leader")
    return at.select(
        "dataset_id", "episode_index", "frame_index",
        *[r6(F.get("positions", F.lit(i))).alias(f"p{i}") for i in range(3)],
    )


@query(
    "P5_frame_records",
    "fo",
    sql="""
SELECT dataset_id, episode_index, frame_index, round(timestamp, 6) AS timestamp, CAST(0 AS BIGINT) AS recorded_at_ns,
       CAST(coalesce(nullif(trim(task), ''), 'session') AS VARCHAR) AS task, round(o2, 6) AS gripper, round(a0, 6) AS shoulder,
       CASE WHEN leader_width = 3 THEN round(a2, 6) END AS leader_gripper
FROM fo""",
)
def p5(t):
    records = P.frame_records(t.frames_orders, F.lit("session"))
    return records.select(
        "dataset_id", "episode_index", "frame_index", r6(F.col("timestamp")).alias("timestamp"), "recorded_at_ns", "task",
        r6(F.col("observation")["gripper"]).alias("gripper"), r6(F.col("action")["shoulder"]).alias("shoulder"),
        r6(F.element_at("leader", F.lit("gripper"))).alias("leader_gripper"),
    )


def trim_requests(t):
    """A request per events episode; some void, some out of range."""
    sizes = full_episodes(t.frames_events).withColumn("fps", F.lit(30))
    e = F.col("episode_index")
    start = F.when(e % 7 == 0, 0).otherwise(e % 20)
    end = F.when(e % 7 == 0, F.col("frames") - 1).when(e % 11 == 0, F.col("frames")).otherwise(e % 20 + 25)
    return sizes, sizes.select("dataset_id", "episode_index", start.alias("keep_start"), end.alias("keep_end"))


TRIM_SQL = """
WITH req AS (SELECT episode_index, n, CASE WHEN episode_index % 7 = 0 THEN 0 ELSE episode_index % 20 END AS s,
                    CASE WHEN episode_index % 7 = 0 THEN n - 1 WHEN episode_index % 11 = 0 THEN n
                         ELSE episode_index % 20 + 25 END AS e
             FROM (SELECT episode_index, max(n) AS n FROM fe GROUP BY 1)),
chk AS (SELECT *, CASE WHEN s < 0 OR e >= n OR s > e THEN 'invalid trim range ' || s || '..' || e || ' for ' || n || ' frames'
                       WHEN s = 0 AND e = n - 1 THEN 'nothing to trim: all frames kept' END AS error FROM req)
"""


@query("V10_check_trim", "fe", sql=TRIM_SQL + "SELECT episode_index, s AS keep_start, e AS keep_end, error FROM chk")
def v10(t):
    sizes, requests = trim_requests(t)
    return P.check_trim(requests, sizes).select("episode_index", "keep_start", "keep_end", "error")


@query(
    "P6_trim",
    "fe",
    sql=TRIM_SQL + """
SELECT fe.episode_index, CASE WHEN c.s IS NULL THEN frame_index ELSE frame_index - c.s END AS frame_index,
       round(CASE WHEN c.s IS NULL THEN timestamp ELSE CAST(CAST((frame_index - c.s) / 30.0 AS FLOAT) AS DOUBLE) END, 6) AS timestamp,
       sample_sequence, captured_at_ns
FROM fe LEFT JOIN (SELECT * FROM chk WHERE error IS NULL) c ON c.episode_index = fe.episode_index
WHERE c.s IS NULL OR frame_index BETWEEN c.s AND c.e""",
)
def p6(t):
    sizes, requests = trim_requests(t)
    accepted = P.check_trim(requests, sizes).where("error IS NULL")
    return P.trim(t.frames_events, accepted).select(
        "episode_index", "frame_index", r6(F.col("timestamp").cast("double")).alias("timestamp"), "sample_sequence",
        "captured_at_ns",
    )


@query(
    "P7_cut",
    "eps", "jrn",
    sql="""
WITH c AS (SELECT e.*, CASE e.episode_index % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'AFTER ' ELSE 'middle' END AS side,
                  greatest(0, least(e.episode_index % 9 - 2, greatest(0, e.frames - 1))) AS spot,
                  a.dataset_id IS NOT NULL AS busy
           FROM eps e LEFT JOIN (SELECT DISTINCT dataset_id FROM jrn WHERE frames >= 11) a ON a.dataset_id = e.dataset_id),
r AS (SELECT *, CASE lower(trim(side)) WHEN 'before' THEN spot WHEN 'after' THEN 0 END AS s,
             CASE lower(trim(side)) WHEN 'before' THEN frames - 1 WHEN 'after' THEN spot END AS e FROM c)
SELECT dataset_id, episode_index, s AS keep_start, e AS keep_end,
  CASE WHEN busy THEN 'dataset is being recorded, trim refused'
       WHEN s IS NULL THEN 'side to trim is one of: ''before'' or ''after'''
       WHEN frames <= 0 OR s < 0 OR e >= frames OR s > e THEN 'invalid trim range ' || s || '..' || e || ' for ' || frames || ' frames'
       WHEN s = 0 AND e = frames - 1 THEN 'nothing to trim: all frames kept' END AS error
FROM r""",
)
def p7(t):
    e = F.col("episode_index")
    side = F.when(e % 3 == 0, "before").when(e % 3 == 1, "AFTER ").otherwise("middle")
    cuts = t.episodes.select("dataset_id", "episode_index", side.alias("side"), (e % 9 - 2).alias("frame_index"))
    active = t.journals.where("frames >= 11")
    return P.cut(cuts, t.episodes, active).select("dataset_id", "episode_index", "keep_start", "keep_end", "error")


@query(
    "P8_classify_stream",
    "ev",
    sql="""
WITH h AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'episode.replay-stream' WHEN 'click' THEN 'episode.sample-stream'
                  WHEN 'error' THEN 'other' ELSE '' END AS kind,
                  CASE WHEN k % 2 = 0 THEN 't' || k ELSE '' END AS token, CASE WHEN k % 3 = 0 THEN 'u' || k END AS url,
                  k % 5 = 0 AS has_frames FROM ev)
SELECT event_id, mode, CASE WHEN mode IS NULL THEN 'no source given: replay or sample stream wanted' END AS error
FROM (SELECT event_id, CASE WHEN kind = 'episode.replay-stream' AND has_frames THEN 'inline'
             WHEN kind = 'episode.replay-stream' OR (kind = '' AND token <> '') THEN 'replay'
             WHEN kind = 'episode.sample-stream' OR (kind = '' AND coalesce(url, '') <> '') THEN 'sample' END AS mode FROM h)""",
)
def p8(t):
    k = F.col("k")
    kind = (
        F.when(F.col("event_type") == "view", KIND_REPLAY).when(F.col("event_type") == "click", KIND_SAMPLE_STREAM)
        .when(F.col("event_type") == "error", "other").otherwise("")
    )
    handles = t.events.select(
        "event_id", kind.alias("kind"), F.when(k % 2 == 0, F.concat(F.lit("t"), k)).otherwise("").alias("token"),
        F.when(k % 3 == 0, F.concat(F.lit("u"), k)).alias("url"), (k % 5 == 0).alias("has_frames"),
    )
    return P.classify_stream(handles).select("event_id", "mode", "error")


@query(
    "P9_resolve_playback",
    "ev",
    sql="""
WITH s AS (SELECT event_id, coalesce(nullif(k % 4 * 15, 0), nullif(user_id % 3 * 20, 0), 30)::DOUBLE AS play_fps,
                  greatest(0.01, coalesce(nullif(k % 5 * 0.25 - 0.25, 0), 1))::DOUBLE AS play_rate,
                  coalesce(CASE k % 3 WHEN 0 THEN 'degrees' WHEN 1 THEN NULL END, CASE WHEN user_id % 2 = 0 THEN 'ticks' END, 'radians')
                    AS play_units FROM ev)
SELECT *, round(1.0 / greatest(1e-3, play_fps * play_rate), 6) AS period_seconds FROM s""",
)
def p9(t):
    k, u = F.col("k"), F.col("user_id")
    asked = t.events.select(
        "event_id", (k % 4 * 15).alias("fps"), (u % 3 * 20).alias("session_fps"),
        (k % 5 * F.lit(0.25) - F.lit(0.25)).alias("rate"),
        F.when(k % 3 == 0, "degrees").when(k % 3 == 1, F.lit(None).cast("string")).otherwise("").alias("units"),
        F.when(u % 2 == 0, "ticks").alias("session_units"),
    )
    return P.resolve_playback(asked).select(
        "event_id", "play_fps", "play_rate", "play_units", r6(F.col("period_seconds")).alias("period_seconds")
    )


@query(
    "P10_register_datasets",
    "ds",
    sql="""
WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN 'NEW-' || c_custkey ELSE 'NATION_' || c_nationkey END AS dataset_id,
                  10 * (1 + c_nationkey % 3 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) AS fps,
                  CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'sort-asia' END AS task FROM customer)
SELECT c_custkey, q.dataset_id, CASE WHEN q.dataset_id IS NULL THEN 'invalid id' WHEN ds.dataset_id IS NULL THEN 'create'
       WHEN ds.fps <> q.fps THEN 'conflict: fps'
       WHEN coalesce(trim(q.task), '') <> '' AND ds.task <> trim(q.task) THEN 'conflict: task' ELSE 'reopen' END AS status
FROM q LEFT JOIN ds ON ds.dataset_id = q.dataset_id""",
)
def p10(t):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    wish = (
        F.when(key % 20 == 0, "///").when(key % 6 == 0, F.concat(F.lit("NEW "), key))
        .otherwise(F.concat(F.lit("-NATION_"), nation))
    )
    requests = t("customer").select(
        "c_custkey", wish.alias("requested_id"), (10 * (1 + nation % 3 + (key % 7 == 0).cast("int"))).alias("fps"),
        F.when(key % 3 == 0, " ").when(key % 3 == 1, "sort-asia").alias("task"),
    )
    return P.register_datasets(requests, t.datasets).select("c_custkey", "dataset_id", "status")


@query(
    "P11_describe",
    "ds", "eps",
    sql="""
SELECT ds.dataset_id, 'datasets/' || ds.dataset_id AS path, ds.fps, ds.task, count(eps.dataset_id) AS episode_count
FROM ds LEFT JOIN eps ON eps.dataset_id = ds.dataset_id GROUP BY ALL""",
)
def p11(t):
    return P.describe(t.datasets, t.episodes)


@query(
    "P12_trim_metadata",
    "fe",
    sql=TRIM_SQL + """
SELECT episode_index, CASE WHEN error IS NULL THEN e - s + 1 ELSE n END AS frames,
       round(CASE WHEN error IS NULL THEN e - s + 1 ELSE n END / 30.0::DOUBLE, 6) AS duration_seconds,
       CASE WHEN error IS NULL THEN n - (e - s + 1) ELSE 0 END AS removed_frames,
       CASE WHEN error IS NULL THEN 1 ELSE 0 END AS history_entries,
       CASE WHEN error IS NULL THEN n END AS source_frames, CASE WHEN error IS NULL THEN s END AS kept_start,
       CASE WHEN error IS NULL THEN e END AS kept_end
FROM chk""",
)
def p12(t):
    sizes, requests = trim_requests(t)
    accepted = P.check_trim(requests, sizes).where("error IS NULL")
    episodes = sizes.withColumn("duration_seconds", X.duration_seconds(F.col("frames"), F.col("fps")))
    last = F.try_element_at("trim_history", F.lit(-1))
    return P.apply_trim_metadata(episodes, accepted).select(
        "episode_index", "frames", r6(F.col("duration_seconds")).alias("duration_seconds"), "removed_frames",
        F.size("trim_history").alias("history_entries"), last["source_frames"].alias("source_frames"),
        last["kept_start"].alias("kept_start"), last["kept_end"].alias("kept_end"),
    )


# --- lookups ------------------------------------------------------------------------------------------------------


@query(
    "L1_frame_at",
    "fe", "ev",
    sql="""
SELECT ev.event_id, fe.episode_index, fe.frame_index, fe.sample_sequence, round(fe.a0, 6) AS a0
FROM ev JOIN fe ON fe.episode_index = ev.user_id AND fe.frame_index = least(greatest(ev.k * 2 - 20, 0), fe.n - 1)""",
)
def l1(t):
    requests = t.events.select(
        F.lit("events-demo").alias("dataset_id"), F.col("user_id").alias("episode_index"), "event_id",
        (F.col("k") * 2 - 20).alias("frame_index"),
    )
    found = P.frame_at(t.frames_events, requests, full_episodes(t.frames_events))
    return found.select(
        "event_id", "episode_index", "frame_index", "sample_sequence",
        r6(F.get("action", F.lit(0)).cast("double")).alias("a0"),
    )


@query(
    "L1_frame_at_keyed",
    "fe", "ev",
    sql="""
SELECT ev.event_id, fe.episode_index, fe.frame_index, fe.sample_sequence, round(fe.a0, 6) AS a0
FROM ev JOIN fe ON fe.episode_index = ev.user_id AND fe.frame_index = least(greatest(ev.k * 2 - 20, 0), fe.n - 1)""",
)
def l1_keyed(t):
    """The same lookups over a table that is laid out by key."""
    requests = t.events.select(
        F.lit("events-demo").alias("dataset_id"), F.col("user_id").alias("episode_index"), "event_id",
        (F.col("k") * 2 - 20).alias("frame_index"),
    )
    found = K.keyed_frame_at(requests, full_episodes(t.frames_events), t.keyed_events)
    return found.select(
        "event_id", "episode_index", "frame_index", "sample_sequence",
        r6(F.get("action", F.lit(0)).cast("double")).alias("a0"),
    )


@query(
    "L2_browse",
    "eps", "ds",
    sql="""
WITH q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' ELSE 'NATION_' || (c_nationkey + c_custkey % 4 * 5) END AS want,
                  c_custkey % 70 AS ep, CASE c_custkey % 5 WHEN 0 THEN 'wrist' WHEN 1 THEN 'side' ELSE '' END AS cam FROM customer),
r AS (SELECT q.*, coalesce(ds.dataset_id, (SELECT arg_min(dataset_id, lower(dataset_id)) FROM ds)) AS dataset_id
      FROM q LEFT JOIN ds ON ds.dataset_id = q.want),
s AS (SELECT r.*, least(greatest(r.ep, 0), m.last) AS episode_index
      FROM r JOIN (SELECT dataset_id, max(episode_index) AS last FROM eps GROUP BY 1) m USING (dataset_id)),
j AS (SELECT s.c_custkey, e.*, CASE WHEN s.cam <> '' THEN s.cam ELSE coalesce(list_sort(e.cameras)[1], '') END AS camera
      FROM s JOIN eps e ON e.dataset_id = s.dataset_id AND e.episode_index = s.episode_index)
SELECT c_custkey, dataset_id, episode_index, frames, fps, camera,
       CASE WHEN NOT list_contains(cameras, camera) THEN 'camera ''' || camera || ''' not recorded; there are: ' ||
            CASE WHEN len(cameras) = 0 THEN 'none' ELSE array_to_string(list_sort(cameras), ', ') END END AS error
FROM j""",
)
def l2(t):
    return P.browse(t.datasets, t.episodes, browse_requests(t)).select(
        "c_custkey", "dataset_id", "episode_index", "frames", "fps", "camera", "error"
    )


def browse_requests(t):
    key = F.col("c_custkey")
    return t("customer").select(
        "c_custkey",
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey") + key % 4 * 5)).alias(
            "requested_dataset"
        ),
        (key % 70).alias("requested_episode"),
        F.when(key % 5 == 0, "wrist").when(key % 5 == 1, "side").otherwise("").alias("requested_camera"),
    )


@query(
    "L2_replay_descriptor",
    "eps", "ds",
    sql="""
WITH q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' ELSE 'NATION_' || (c_nationkey + c_custkey % 4 * 5) END AS want,
                  c_custkey % 70 AS ep, CASE c_custkey % 5 WHEN 0 THEN 'wrist' WHEN 1 THEN 'side' ELSE '' END AS cam FROM customer),
r AS (SELECT q.*, coalesce(ds.dataset_id, (SELECT arg_min(dataset_id, lower(dataset_id)) FROM ds)) AS dataset_id
      FROM q LEFT JOIN ds ON ds.dataset_id = q.want),
s AS (SELECT r.*, least(greatest(r.ep, 0), m.last) AS episode_index
      FROM r JOIN (SELECT dataset_id, max(episode_index) AS last FROM eps GROUP BY 1) m USING (dataset_id)),
j AS (SELECT s.c_custkey, e.*, CASE WHEN s.cam <> '' THEN s.cam ELSE coalesce(list_sort(e.cameras)[1], '') END AS camera
      FROM s JOIN eps e ON e.dataset_id = s.dataset_id AND e.episode_index = s.episode_index)
SELECT c_custkey, dataset_id, episode_index, camera, error IS NULL AS found,
       CASE WHEN error IS NULL THEN 'datasets/' || dataset_id || '/episodes/episode-' || lpad(CAST(episode_index AS VARCHAR), 6, '0') || '/cameras/' || camera || '.mp4' END AS video_path,
       CASE WHEN list_contains(cameras, camera) AND camera = 'front' THEN 'pinhole' END AS camera_model, 'L-' || o_orderkey AS leader,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS robot_keys, coalesce(units, '') AS units, round(coalesce(duration_seconds, 0), 6) AS duration_seconds
FROM (SELECT *, CASE WHEN NOT list_contains(cameras, camera) THEN 'x' END AS error FROM j)""",
)
def l2_descriptor(t):
    """Descriptors with the robot's identity and what is known of the chosen camera."""
    key = F.substring("run_id", 5, 20).cast("long")
    robot = F.struct(F.concat(F.lit("L-"), key).alias("leader_hardware_id"), F.when(key % 3 == 0, F.concat(F.lit("F-"), key)).alias("follower_hardware_id"))
    facts = F.map_from_arrays(
        "cameras", F.transform("cameras", lambda c: F.when(c == "front", F.create_map(F.lit("camera_model"), F.lit("pinhole"))).otherwise(F.create_map().cast("map<string,string>")))
    )
    out = P.replay_descriptor(t.datasets, t.episodes.withColumns({"robot": robot, "camera_info": facts}), browse_requests(t))
    return out.select(
        "c_custkey", "dataset_id", "episode_index", "camera", F.col("error").isNull().alias("found"), "video_path",
        F.col("camera_info")["camera_model"].alias("camera_model"), F.col("robot")["leader_hardware_id"].alias("leader"),
        F.size("robot").alias("robot_keys"), "units", r6(F.col("duration_seconds")).alias("duration_seconds"),
    )


# --- de-duplication -----------------------------------------------------------------------------------------------

HANDLES_SQL = """
WITH h AS (SELECT user_id AS request_id, event_id AS position, CASE k % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'single' ELSE 'socket' END AS source,
                  CASE WHEN event_type = 'error' THEN 'other' ELSE 'episode.frame-stream' END AS kind,
                  CASE WHEN k % 7 = 0 THEN ' ' ELSE 'cam' || (k % 6) END AS stream_id,
                  CASE WHEN k % 11 = 0 THEN NULL ELSE 'url-' || event_id END AS snapshot_url FROM ev)
"""


def camera_handles(t):
    k = F.col("k")
    return t.events.select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("position"),
        F.when(k % 3 == 0, "list").when(k % 3 == 1, "single").otherwise("socket").alias("source"),
        F.when(F.col("event_type") == "error", "other").otherwise(KIND_CAMERA_STREAM).alias("kind"),
        F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("cam"), k % 6)).alias("stream_id"),
        F.when(k % 11 != 0, F.concat(F.lit("url-"), "event_id")).alias("snapshot_url"),
    )


@query(
    "D1_dedupe_last",
    "ev",
    sql=HANDLES_SQL + """,
m AS (SELECT *, kind = 'episode.frame-stream' AND trim(stream_id) <> '' AND snapshot_url IS NOT NULL AS ok,
             CASE source WHEN 'list' THEN 0 WHEN 'single' THEN 1 ELSE 2 END * 1000000000000 + position AS place FROM h),
g AS (SELECT request_id, stream_id, arg_max(snapshot_url, place) AS snapshot_url, min(place) AS place FROM m WHERE ok GROUP BY ALL)
SELECT g.request_id, stream_id, snapshot_url, CAST(row_number() OVER (PARTITION BY g.request_id ORDER BY place) - 1 AS INTEGER) AS position, ignored
FROM g JOIN (SELECT request_id, count(*) FILTER (NOT ok) AS ignored FROM m GROUP BY 1) i ON i.request_id = g.request_id""",
)
def d1(t):
    return P.dedupe_cameras_last(camera_handles(t), KIND_CAMERA_STREAM)


@query(
    "D2_dedupe_first",
    "ev",
    sql=HANDLES_SQL + """,
m AS (SELECT *, CASE WHEN trim(stream_id) = '' THEN 'camera' ELSE stream_id END AS sid, kind <> 'episode.frame-stream' AS wrong FROM h)
SELECT r.request_id, sid AS stream_id, url AS snapshot_url, pos AS position,
       CASE WHEN bad THEN 'every camera must be of kind episode.frame-stream handles' WHEN sid IS NULL THEN 'no camera given' END AS error
FROM (SELECT request_id, bool_or(wrong) AS bad FROM m GROUP BY 1) r
LEFT JOIN (SELECT request_id, sid, first(snapshot_url ORDER BY position) AS url, min(position) AS pos FROM m WHERE NOT wrong GROUP BY ALL) k
  ON k.request_id = r.request_id""",
)
def d2(t):
    return P.dedupe_cameras_first(camera_handles(t), KIND_CAMERA_STREAM).select(
        "request_id", "stream_id", "snapshot_url", "position", "error"
    )


@query(
    "D3_union_frames",
    "fe", "fv",
    sql="""
SELECT dataset_id, episode_index, frame_index, CAST(3 AS INTEGER) AS width, task FROM fe
UNION ALL SELECT dataset_id, episode_index, frame_index, CAST(len(embedding) AS INTEGER), NULL FROM fv""",
)
def d3(t):
    both = P.union_frames(t.frames_events, t.frames_vec.drop("vec_id"))
    return both.select(
        "dataset_id", "episode_index", "frame_index", F.size("observation_state").alias("width"), "task"
    )


@query(
    "D4_camera_names",
    "cam",
    sql="SELECT DISTINCT 'events-demo' AS dataset_id, run_id AS episode_index, camera FROM cam WHERE NOT empty",
)
def d4(t):
    stamp = F.struct(F.col("sequence").alias("sequence"), F.col("captured_at_ns").alias("captured_at_ns"))
    frames = t.camera_frames.where(~F.col("empty")).select(
        F.lit("events-demo").alias("dataset_id"), F.col("run_id").alias("episode_index"),
        F.create_map("camera", stamp).alias("cameras"),
    )
    return P.camera_names(frames)
