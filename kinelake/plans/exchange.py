"""Validation, sources, exports and replay over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinelake.operators import aggregates as A
from kinelake.operators import joins as J
from kinelake.operators import quality as Q
from kinelake.operators.blocks import dense_index
from kinelake.plans.basics import r6
from kinelake.plans.fixtures import JOINTS, OPEN, SHUT, is_open
from kinelake.plans.ordered import BAD_MANIFESTS_SQL, bad_manifests, synced
from kinelake.plans.registry import cte, query
from kinelake.schema import KIND_DATASET, KIND_SAMPLE
from kinelake.session import block_rows, shared_folder, stage
from kinelake.sources import catalog as C
from kinelake.sources import export as X
from kinelake.sources import journals as R
from kinelake.sources import replay as Y
from kinelake.sources import tables as S

CAMERAS = ("front", "wrist")


def scratch(t, name: str) -> str:
    """A folder of its own for a round trip, beside the other intermediate tables."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def facts(t):
    return J.episode_facts(t.datasets, t.episodes, t.frames_orders)


# --- validation ---------------------------------------------------------------------------------------------------

cte(
    "v2",
    """
SELECT dataset_id, episode_index, 'V2' AS rule, 'error' AS severity, 'episode manifest index ' || episode_index || ' is not sequential at ' || place AS message
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY episode_index) - 1 AS place FROM eps) WHERE place <> episode_index""",
    "eps",
)
cte(
    "v3",
    """
SELECT dataset_id, episode_index, 'V3' AS rule, 'error' AS severity, 'missing frame-data' AS message FROM eps WHERE rows = 0
UNION ALL SELECT dataset_id, episode_index, 'V3', 'error', 'missing episode-info' FROM eps WHERE o_orderkey % 101 = 0""",
    "eps",
)
cte(
    "v4",
    """
SELECT dataset_id, episode_index, 'V4' AS rule, 'error' AS severity, 'episode ' || episode_index || ' has its joints in another order than the dataset' AS message
FROM eps WHERE joint_names <> 'shoulder,elbow,gripper'""",
    "eps",
)
cte(
    "v5",
    """
SELECT DISTINCT dataset_id, episode_index, 'V5' AS rule, 'error' AS severity, 'episode ' || episode_index || ' has timestamps that do not rise' AS message
FROM (SELECT *, lag(timestamp) OVER w >= timestamp AS late FROM fo WINDOW w AS (PARTITION BY dataset_id, episode_index ORDER BY frame_index)) WHERE late""",
    "fo",
)
cte(
    "v6",
    """
SELECT dataset_id, episode_index, 'V6' AS rule, 'error' AS severity, 'episode ' || episode_index || ' has another number of rows than frames' AS message
FROM eps WHERE rows > 0 AND frames <> rows""",
    "eps",
)
cte(
    "v7",
    """
SELECT dataset_id, episode_index, 'V7' AS rule, 'error' AS severity, 'episode ' || episode_index || ' has no video of camera ' || camera AS message
FROM (SELECT dataset_id, episode_index, o_orderkey, unnest(cameras) AS camera FROM eps) WHERE camera = 'wrist' AND o_orderkey % 53 = 0""",
    "eps",
)
cte(
    "v7w",
    """
SELECT DISTINCT dataset_id, episode_index, 'V7' AS rule, 'error' AS severity, 'episode ' || episode_index || ' has vectors of the wrong width' AS message
FROM fo WHERE leader_width <> 3""",
    "fo",
)
cte(
    "v8",
    """
SELECT dataset_id, NULL::BIGINT AS episode_index, 'V8' AS rule, 'warning' AS severity, 'unfinished run to save or discard: ' || run_id AS message FROM rec""",
    "rec",
)
cte("v1", f"SELECT dataset_id, NULL::BIGINT AS episode_index, 'V1' AS rule, 'error' AS severity, error AS message FROM ({BAD_MANIFESTS_SQL})")


def files(t):
    """Artifacts and media as a listing would give them; some are missing."""
    key = F.substring("run_id", 5, 20).cast("long")
    base = t.episodes.select("dataset_id", "episode_index", key.alias("key"), "cameras")
    with_rows = A.full_episodes(t.frames_orders).select("dataset_id", "episode_index")
    none = F.lit(None).cast("string")
    info = base.where("key % 101 <> 0").select("dataset_id", "episode_index", F.lit("episode-info").alias("artifact"), none.alias("camera"))
    data = with_rows.select("dataset_id", "episode_index", F.lit("frame-data").alias("artifact"), none.alias("camera"))
    media = base.select("dataset_id", "episode_index", "key", F.explode("cameras").alias("camera")).where(
        "camera <> 'wrist' or key % 53 <> 0"
    )
    media = media.select("dataset_id", "episode_index", F.lit("media").alias("artifact"), "camera")
    return info.unionByName(data).unionByName(media)


@query("V1_check_manifest", "v1", sql="SELECT * FROM v1")
def v1(t):
    return Q.check_manifest(bad_manifests(t))


@query("V2_check_sequential", "v2", sql="SELECT * FROM v2")
def v2(t):
    return Q.check_sequential(t.episodes)


@query(
    "V2_shuffled_manifest",
    "eps",
    sql="""
SELECT dataset_id, episode_index, 'V2' AS rule, 'error' AS severity, 'episode manifest index ' || episode_index || ' is not sequential at ' || place AS message
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY o_orderkey % 7, episode_index) - 1 AS place FROM eps) WHERE place <> episode_index""",
)
def v2_shuffled(t):
    """A manifest that lists its episodes in another order."""
    key = F.regexp_extract("run_id", "[0-9]+", 0).cast("long")
    return Q.check_sequential(t.episodes.withColumn("position", key % 7))


@query("V3_check_artifacts", "v3", sql="SELECT * FROM v3")
def v3(t):
    return Q.check_artifacts(t.episodes, files(t))


@query("V4_check_joint_order", "v4", sql="SELECT * FROM v4")
def v4(t):
    return Q.check_joint_order(t.episodes, t.datasets)


@query("V5_check_timestamps", "v5", sql="SELECT * FROM v5")
def v5(t):
    return Q.check_timestamps(t.frames_orders)


@query("V6_check_counts", "v6", sql="SELECT * FROM v6")
def v6(t):
    return Q.check_counts(t.episodes, t.frames_orders)


@query("V7_check_cameras", "v7", sql="SELECT * FROM v7")
def v7(t):
    return Q.check_cameras(t.episodes, files(t).where("camera IS NOT NULL"))


@query("V7_check_width", "v7w", sql="SELECT * FROM v7w")
def v7w(t):
    return Q.check_width(t.frames_orders)


@query("V8_warn_incomplete", "v8", sql="SELECT * FROM v8")
def v8(t):
    return Q.warn_incomplete(t.journals, t.episodes)


ALL_SQL = " UNION ALL ".join(f"SELECT * FROM {v}" for v in ("v1", "v2", "v3", "v4", "v5", "v6", "v7", "v7w", "v8"))


@query(
    "V_validation_report",
    "v1", "v2", "v3", "v4", "v5", "v6", "v7", "v7w", "v8", "ds",
    sql=f"""
WITH v AS ({ALL_SQL}), c AS (SELECT dataset_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM v GROUP BY 1)
SELECT d.dataset_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS ok
FROM (SELECT dataset_id FROM ds UNION SELECT dataset_id FROM c) d LEFT JOIN c ON c.dataset_id = d.dataset_id""",
)
def v_all(t):
    found = Q.validate(bad_manifests(t), t.datasets, t.episodes, t.frames_orders, files(t), t.journals)
    return Q.validation_report(t.datasets, found).select("dataset_id", "errors", "warnings", "ok")


# --- sources ------------------------------------------------------------------------------------------------------


@query(
    "S1_read_frames",
    "fo",
    sql="""
SELECT dataset_id, episode_index, count(*) AS frames, coalesce(arg_min(task, frame_index) FILTER (trim(task) <> ''), '') AS task, CAST(max(leader_width) AS INTEGER) AS leader_width,
       round(sum(o0), 4) AS total FROM fo GROUP BY ALL""",
)
def s1(t):
    path = scratch(t, "frames")
    t.frames_orders.withColumn("episode_id", F.lit(None).cast("string")).write.parquet(path)
    frames = S.read_frames(t.spark, path)
    sums = frames.groupBy("dataset_id", "episode_index").agg(
        F.count("*").alias("frames"), F.max(F.size("leader_state")).alias("leader_width"),
        F.round(F.sum(F.get("observation_state", F.lit(0)).cast("double")), 4).alias("total"),
    )
    return sums.join(S.episode_task(frames), ["dataset_id", "episode_index"])


cte(
    "jl",
    """
SELECT 'run-' || o_orderkey AS run_id, dataset_id, o_orderkey, frame_index, CAST(CAST(frame_index / fps AS FLOAT) AS DOUBLE) AS timestamp, l_partkey AS sequence,
       CAST(CAST(l_quantity / 50 AS FLOAT) AS DOUBLE) AS o0, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS a0
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
             l_returnflag, l_linestatus, l_shipdate) - 1 AS frame_index FROM lineitem) l JOIN ord ON o_orderkey = l_orderkey WHERE open""",
    "ord",
)


def _journal_lines(t):
    """Open recordings as their journals: one JSON text per frame; some runs change their joint order midway."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]
    block = F.floor(F.col("l_linenumber") / 4096).cast("long")
    open_orders = t.orders.where("open").select("o_orderkey", "dataset_id", "fps", "task", "rows")
    short = (open_orders.agg(F.max("rows")).first()[0] or 0) <= block_rows(t.spark)
    # Lines of closed recordings have no journal; only the others are shuffled.
    lines = t("lineitem").where(is_open(F.col("l_orderkey"))).join(open_orders.drop("rows"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = dense_index(lines, ["o_orderkey"], order, block, "frame_index", short)
    names = F.array(*[F.lit(j) for j in JOINTS])
    turned = (F.col("o_orderkey") % 150 == 0) & (F.col("frame_index") == 1)
    obs = F.array((F.col("l_quantity") / 50), F.col("l_tax"), F.when(F.col("l_linestatus") == "O", OPEN).otherwise(SHUT))
    act = F.array(F.col("l_discount"), F.col("l_tax"), F.when(F.col("l_returnflag") == "N", OPEN).otherwise(SHUT))

    def laid(values):
        return F.when(turned, F.reverse(values)).otherwise(values)

    order_names = laid(names)
    robot = F.struct(
        F.lit(KIND_SAMPLE).alias("kind"), F.col("l_partkey").alias("sequence"), order_names.alias("joint_names"),
        F.map_from_arrays(order_names, laid(obs)).alias("observation"),
        F.map_from_arrays(order_names, laid(act)).alias("action"), F.map_from_arrays(order_names, laid(act)).alias("leader"), F.lit("radians").alias("units"),
    )
    frame = F.struct(
        "frame_index", (F.col("frame_index") / F.col("fps")).alias("timestamp"), "task", robot.alias("robot"),
        F.concat(F.lit("run-"), "o_orderkey").alias("run_id"),
    )
    return rows.select(F.to_json(frame).alias("value"))


def journal(t):
    path = scratch(t, "journal")
    blank = t("region").select(F.lit("").alias("value"))
    broken = t("region").select(F.concat(F.lit('{"frame_index": '), F.col("r_name")).alias("value"))
    _journal_lines(t).unionByName(blank).unionByName(broken).write.text(path)
    return R.read_journal(t.spark, path)


@query(
    "S2_read_journal",
    "jl",
    sql="""
SELECT run_id, frame_index, round(timestamp, 4) AS timestamp, round(o0, 6) AS shoulder FROM jl
UNION ALL SELECT 'unreadable', NULL, NULL, NULL FROM region""",
)
def s2(t):
    lines = journal(t)
    run = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").otherwise(F.col("run_id"))
    return lines.select(
        run.alias("run_id"), "frame_index", F.round("timestamp", 4).alias("timestamp"),
        F.round(F.col("robot.observation")["shoulder"].cast("float").cast("double"), 6).alias("shoulder"),
    )


def open_runs(t):
    return t.orders.where("open").select(
        F.concat(F.lit("run-"), "o_orderkey").alias("run_id"), "dataset_id", "episode_index", "fps", "task",
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
    )


@query(
    "V9_check_journal",
    "jrn", "rec", "jl",
    sql="""
SELECT r.dataset_id, r.run_id, r.frames, CASE WHEN r.frames = 0 THEN 'episode without frames not saved'
       WHEN CAST(substring(r.run_id, 5) AS BIGINT) % 150 = 0 AND r.frames > 1 THEN 'joint order changes within the run'
       WHEN r.dataset_id = 'NATION_3' THEN 'joint order is not that of the saved episodes' END AS error FROM rec r""",
)
def v9(t):
    known = t.datasets.select(
        "dataset_id",
        F.when(F.col("dataset_id") == "NATION_3", F.reverse("joint_names")).otherwise(F.col("joint_names")).alias("joint_names"),
    )
    return R.check_journal(R.journal_vectors(journal(t)), open_runs(t), known).select("dataset_id", "run_id", "frames", "error")


@query(
    "S6_compact_journals",
    "jl",
    sql="""
SELECT dataset_id, run_id, frame_index, sequence AS sample_sequence, CAST(0 AS BIGINT) AS captured_at_ns, round(o0, 6) AS o0, round(a0, 6) AS a0
FROM jl WHERE NOT (o_orderkey % 150 = 0 AND o_orderkey IN (SELECT o_orderkey FROM jl GROUP BY 1 HAVING count(*) > 1))""",
)
def s6(t):
    frames, _ = R.compact_journals(journal(t), open_runs(t), t.datasets)
    return frames.select(
        "dataset_id", "run_id", "frame_index", "sample_sequence", "captured_at_ns",
        r6(F.get("observation_state", F.lit(0)).cast("double")).alias("o0"),
        r6(F.get("action", F.lit(0)).cast("double")).alias("a0"),
    )


@query(
    "S6_save_episodes",
    "rec", "jl",
    sql="""
WITH a AS (SELECT *, CAST(substring(run_id, 5) AS BIGINT) % 150 AS k FROM rec),
b AS (SELECT *, CASE WHEN k = 100 THEN 'discarded' WHEN frames = 0 THEN 'episode without frames not saved'
       WHEN k = 0 AND frames > 1 THEN 'joint order changes within the run' ELSE 'saved' END AS status FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY k <> 50, started_at, run_id) - 1 AS place FROM b WHERE status = 'saved'),
f AS (SELECT run_id, count(*) AS frame_rows, round(sum(o0), 4) AS total FROM jl GROUP BY 1)
SELECT b.dataset_id, b.run_id, b.status, c.place AS episode_index, c.frames, 'episodes/episode-' || lpad(CAST(c.place AS VARCHAR), 6, '0') AS path,
       round(c.frames / CAST(c.fps AS DOUBLE), 6) AS duration_seconds, CASE WHEN c.run_id IS NOT NULL THEN frame_rows END AS frame_rows, CASE WHEN c.run_id IS NOT NULL THEN total END AS total
FROM b LEFT JOIN c ON c.run_id = b.run_id LEFT JOIN f ON f.run_id = b.run_id""",
)
def s6_save(t):
    """Unfinished runs finalised in one commit, the others saved or discarded in a second, then the first call repeated."""
    root, lines, runs = scratch(t, "saved"), stage(journal(t)), open_runs(t).drop("episode_index")
    # Unreadable journal lines carry the name of their folder as run, which is no number.
    key = F.expr("try_cast(substring(run_id, 5, 20) AS BIGINT)") % 150
    fresh = t.datasets.select("dataset_id", F.lit(None).cast("array<string>").alias("joint_names"))
    asked = runs.select("dataset_id", "run_id", F.when(key == 50, " Finalize").when(key == 0, "save").otherwise("discard").alias("action"))
    first, second = asked.where("action = ' Finalize'"), asked.where("action <> ' Finalize'")
    _, a = R.close_runs(lines, runs, fresh, first, root)
    held, b = R.close_runs(lines, runs, fresh, second, root)
    again, _ = R.close_runs(lines, runs, fresh, first, root)
    if again != held:
        raise AssertionError("a repeated call changed the tables")
    saved = R.saved_tables(t.spark, root)
    sums = saved["frames"].groupBy("dataset_id", "episode_index").agg(
        F.count("*").alias("frame_rows"), F.round(F.sum(F.get("observation_state", F.lit(0)).cast("double")), 4).alias("total")
    )
    entry = saved["manifest"].join(saved["episodes"].select("episode_id", "run_id"), "episode_id").join(sums, ["dataset_id", "episode_index"])
    entry = entry.select("dataset_id", "run_id", "episode_index", "frames", "path", r6(F.col("duration_seconds")).alias("duration_seconds"), "frame_rows", "total")
    return a.union(b).select("dataset_id", "run_id", "status").join(entry, ["dataset_id", "run_id"], "left")


def manifest_texts(t):
    """Manifests as JSON text; a few are of another kind or version, or no JSON at all."""
    entry = F.struct("episode_id", "episode_index", "frames", "duration_seconds", "task")
    # A manifest is one document by definition of the format.
    listed = t.episodes.groupBy("dataset_id").agg(F.array_sort(F.collect_list(entry)).alias("episodes"))
    n = F.col("n_nationkey")
    body = F.to_json(
        F.struct(
            F.when(n % 11 == 4, "other").otherwise(KIND_DATASET).alias("kind"),
            F.when(n % 7 == 5, 2).otherwise(1).alias("schema_version"), "dataset_id", "fps", "task", "robot_type",
            F.struct("joint_names", "units").alias("features"), "episodes",
        )
    )
    text = F.when(n % 13 == 6, F.concat(F.lit("<"), body)).otherwise(body)
    return t.datasets.drop("cameras").join(listed, ["dataset_id"], "left").select("n_nationkey", text.alias("value"))


@query(
    "S3_read_catalog",
    "ds", "eps",
    sql="""
SELECT CASE WHEN error IS NULL THEN dataset_id END AS dataset_id, error, CASE WHEN error IS NULL THEN n END AS episodes FROM (
SELECT ds.dataset_id, coalesce(c.n, 0) AS n, CASE WHEN n_nationkey % 13 = 6 THEN 'manifest is not readable JSON' WHEN n_nationkey % 11 = 4 THEN 'not an episode dataset manifest'
       WHEN n_nationkey % 7 = 5 THEN 'unsupported manifest version' END AS error
FROM ds LEFT JOIN (SELECT dataset_id, CAST(count(*) AS INTEGER) AS n FROM eps GROUP BY 1) c ON c.dataset_id = ds.dataset_id)""",
)
def s3(t):
    path = scratch(t, "catalog")
    manifest_texts(t).write.partitionBy("n_nationkey").text(path)
    catalog = C.read_catalog(t.spark, f"{path}/*/*.txt")
    good = F.col("error").isNull()
    return catalog.select(
        F.when(good, F.col("dataset_id")).alias("dataset_id"), "error", F.when(good, F.size("episodes")).alias("episodes")
    )


# --- sinks --------------------------------------------------------------------------------------------------------


@query(
    "S7_write_native",
    "sync",
    sql="""
SELECT run_id AS episode_index, sequence AS sample_sequence, captured_at_ns, round(j0, 6) AS o0, front_sequence AS "camera.front.sequence",
       front_at AS "camera.front.captured_at_ns", wrist_sequence AS "camera.wrist.sequence", wrist_at AS "camera.wrist.captured_at_ns" FROM sync WHERE reason IS NULL""",
)
def s7(t):
    good = synced(t).where("reason IS NULL").join(t.samples.drop("captured_at_ns"), ["run_id", "sequence"])
    vector = F.transform("joint_names", lambda n: F.element_at("observation", n).cast("float"))
    frames = good.select(
        F.lit("events-demo").alias("dataset_id"), F.col("run_id").alias("episode_index"),
        F.col("sequence").alias("sample_sequence"), "captured_at_ns", vector.alias("observation_state"), "cameras",
    )
    path = scratch(t, "native")
    S.write_native(frames, path, CAMERAS)
    back = t.spark.read.parquet(path)
    pairs = [F.col(f"`camera.{c}.{k}`").alias(f"camera.{c}.{k}") for c in CAMERAS for k in ("sequence", "captured_at_ns")]
    return back.select(
        "episode_index", "sample_sequence", "captured_at_ns",
        r6(F.get(F.col("`observation.state`"), F.lit(0)).cast("double")).alias("o0"), *pairs,
    )


@query(
    "S8_lerobot_frames",
    "fo",
    sql="""
SELECT dataset_id, episode_index, frame_index, row_number() OVER (PARTITION BY dataset_id ORDER BY episode_index, frame_index) - 1 AS index,
       CAST(0 AS BIGINT) AS task_index, round(timestamp, 6) AS timestamp, round(o0, 6) AS o0, round(a0, 6) AS a0 FROM fo""",
)
def s8(t):
    return X.lerobot_frames(t.frames_orders).select(
        "dataset_id", "episode_index", "frame_index", "index", "task_index", r6(F.col("timestamp").cast("double")).alias("timestamp"),
        r6(F.get(F.col("`observation.state`"), F.lit(0)).cast("double")).alias("o0"),
        r6(F.get("action", F.lit(0)).cast("double")).alias("a0"),
    )


@query(
    "S8_lerobot_frames_smoothed",
    "fga", "fel",
    sql="""
SELECT p.episode_index, p.frame_index, row_number() OVER (ORDER BY p.episode_index, p.frame_index) - 1 AS index, round(CAST(CAST(p.v AS FLOAT) AS DOUBLE), 5) AS a0
FROM fga p WHERE p.joint = 0""",
)
def s8_smoothed(t):
    return X.lerobot_frames(t.frames_events, "gaussian", 1.0, 30.0).select(
        "episode_index", "frame_index", "index", (F.round(F.get("action", F.lit(0)).cast("double"), 5)).alias("a0")
    )


def present(t):
    """Episodes that have frames, with the rows they really hold."""
    return facts(t).where("row_count IS NOT NULL").select(
        "dataset_id", "episode_index", F.col("row_count").alias("frames"), F.col("manifest_fps").alias("fps"),
        F.col("manifest_task").alias("task"),
    )


@query(
    "S9_lerobot_episodes",
    "eps", "ds",
    sql="""
SELECT e.dataset_id, episode_index, d.task AS tasks, rows AS length, CAST(sum(rows) OVER w - rows AS BIGINT) AS dataset_from_index, CAST(sum(rows) OVER w AS BIGINT) AS dataset_to_index,
       CAST(0 AS BIGINT) AS "data/chunk_index", episode_index AS "data/file_index", CAST(0 AS BIGINT) AS "meta/episodes/chunk_index", CAST(0 AS BIGINT) AS "meta/episodes/file_index",
       CAST(0 AS BIGINT) AS "videos/observation.images.front/chunk_index", episode_index AS "videos/observation.images.front/file_index",
       0.0::DOUBLE AS "videos/observation.images.front/from_timestamp", round(rows::DOUBLE / d.fps, 6) AS "videos/observation.images.front/to_timestamp",
       CAST(0 AS BIGINT) AS "videos/observation.images.wrist/chunk_index", episode_index AS "videos/observation.images.wrist/file_index",
       0.0::DOUBLE AS "videos/observation.images.wrist/from_timestamp", round(rows::DOUBLE / d.fps, 6) AS "videos/observation.images.wrist/to_timestamp"
FROM eps e JOIN ds d ON d.dataset_id = e.dataset_id WHERE rows > 0 WINDOW w AS (PARTITION BY e.dataset_id ORDER BY episode_index ROWS UNBOUNDED PRECEDING)""",
)
def s9(t):
    out = X.lerobot_episodes(present(t), CAMERAS)
    ends = [f"videos/observation.images.{c}/to_timestamp" for c in CAMERAS]
    return out.withColumns({"tasks": F.concat_ws(",", "tasks"), **{end: F.round(F.col(f"`{end}`"), 6) for end in ends}})


def camera_table(t):
    return t.datasets.select(
        "dataset_id", F.explode("cameras").alias("camera"), F.lit(480).alias("height"), F.lit(640).alias("width"),
        F.lit(None).cast("int").alias("channels"),
    )


@query(
    "S10_lerobot_features",
    "ds",
    sql="""
SELECT dataset_id, f.feature, f.dtype, f.shape FROM ds, LATERAL (VALUES ('observation.state', 'float32', '3'), ('action', 'float32', '3'), ('timestamp', 'float32', '1'),
  ('frame_index', 'int64', '1'), ('episode_index', 'int64', '1'), ('index', 'int64', '1'), ('task_index', 'int64', '1'),
  ('observation.images.front', 'video', '480,640,3'), ('observation.images.wrist', 'video', '480,640,3')) AS f(feature, dtype, shape)""",
)
def s10_features(t):
    out = X.lerobot_features(t.datasets, camera_table(t))
    return out.select("dataset_id", "feature", "dtype", F.concat_ws(",", F.col("shape").cast("array<string>")).alias("shape"))


@query(
    "S10_lerobot_info",
    "eps", "ds",
    sql="""
SELECT d.dataset_id, 'v3.0' AS codebase_version, d.fps, count(*) AS total_episodes, CAST(sum(rows) AS BIGINT) AS total_frames, '0:' || count(*) AS train, d.robot_type, CAST(9 AS INTEGER) AS features,
       d.task AS task
FROM eps e JOIN ds d ON d.dataset_id = e.dataset_id WHERE rows > 0 GROUP BY ALL""",
)
def s10_info(t):
    totals = A.export_totals(t.frames_orders, camera_table(t))
    info = X.lerobot_info(t.datasets, totals, X.lerobot_features(t.datasets, camera_table(t)))
    return info.join(X.lerobot_tasks(t.datasets), "dataset_id").select(
        "dataset_id", "codebase_version", "fps", "total_episodes", "total_frames", F.col("splits")["train"].alias("train"),
        "robot_type", F.size("features").alias("features"), "task",
    )


@query(
    "S10_lerobot_stats",
    "fo",
    sql="""
SELECT dataset_id, c.feature, c.joint, count(*) AS "count", round(min(c.v), 6) AS "min", round(max(c.v), 6) AS "max", round(avg(c.v), 5) AS "mean", round(stddev_pop(c.v), 5) AS "std"
FROM fo, LATERAL (VALUES ('observation.state', 0, o0), ('observation.state', 1, o1), ('observation.state', 2, o2), ('action', 0, a0), ('action', 1, a1), ('action', 2, a2)) AS c(feature, joint, v)
GROUP BY ALL""",
)
def s10_stats(t):
    """The stats documents, parsed again."""
    texts = X.lerobot_stats_documents(X.lerobot_stats(t.frames_orders))
    vector = "struct<min:array<double>,max:array<double>,mean:array<double>,std:array<double>,count:array<bigint>>"
    parsed = texts.select("dataset_id", F.explode(F.from_json("value", f"map<string,{vector}>")).alias("feature", "s"))
    joints = parsed.select("dataset_id", "feature", F.posexplode(F.arrays_zip("s.min", "s.max", "s.mean", "s.std", "s.count")).alias("joint", "j"))
    return joints.select(
        "dataset_id", "feature", "joint", "j.count", *[r6(F.col(f"j.{c}")).alias(c) for c in ("min", "max")],
        *[F.round(f"j.{c}", 5).alias(c) for c in ("mean", "std")],
    )


@query(
    "S10_lerobot_video_info",
    "ds",
    sql="""
SELECT dataset_id, 'observation.images.' || camera AS feature, 480 AS height, 640 AS width, 'mpeg4' AS codec, 'yuv420p' AS pixels, CAST(fps AS INTEGER) AS fps, 3 AS channels
FROM ds, LATERAL (VALUES ('front'), ('wrist')) AS c(camera)""",
)
def s10_video(t):
    out = X.lerobot_video_info(t.datasets, camera_table(t))
    return out.select(
        "dataset_id", "feature", F.col("info")["video.height"].alias("height"), F.col("info")["video.width"].alias("width"),
        F.col("info")["video.codec"].alias("codec"), F.col("info")["video.pix_fmt"].alias("pixels"), F.col("info")["video.fps"].cast("int").alias("fps"),
        F.col("info")["video.channels"].alias("channels"),
    )


HUB_ID = "coalesce(nullif(trim(e.episode_id), ''), e.dataset_id || '-episode-' || lpad(CAST(e.episode_index AS VARCHAR), 6, '0'))"


@query(
    "S11_hub_frames",
    "fo", "eps",
    sql=f"""
SELECT fo.dataset_id, {HUB_ID} AS episode_id, fo.episode_index, fo.frame_index, round(fo.o0, 6) AS o0
FROM fo JOIN eps e ON e.dataset_id = fo.dataset_id AND e.episode_index = fo.episode_index""",
)
def s11(t):
    return X.hub_frames(t.frames_orders, facts(t)).select(
        "dataset_id", "episode_id", "episode_index", "frame_index",
        r6(F.get("observation_state", F.lit(0)).cast("double")).alias("o0"),
    )


cte(
    "hub",
    f"""
SELECT e.dataset_id, {HUB_ID} AS episode_id, e.episode_index, coalesce(nullif(trim(e.task), ''), d.task) AS task, rows AS frames, d.fps,
       round(coalesce(nullif(e.duration_seconds, 0), rows::DOUBLE / d.fps), 6) AS duration_seconds, d.robot_type, coalesce(e.units, d.units) AS units,
       strftime(e.started_at, '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(coalesce(e.completed_at, e.saved_at), '%Y-%m-%dT%H:%M:%SZ') AS completed_at,
       lpad(CAST(e.episode_index AS VARCHAR), 6, '0') AS pad
FROM eps e JOIN ds d ON d.dataset_id = e.dataset_id""",
    "eps", "ds",
)


@query(
    "S12_hub_episodes",
    "hub",
    sql="""
SELECT * EXCLUDE (pad), 'media/videos/front/episode-' || pad || '.mp4' AS front_file_name, 'media/videos/wrist/episode-' || pad || '.mp4' AS wrist_file_name FROM hub""",
)
def s12(t):
    return X.hub_episodes(facts(t), CAMERAS).withColumn("duration_seconds", r6(F.col("duration_seconds")))


@query(
    "S13_hub_media",
    "hub",
    sql="""
SELECT dataset_id, episode_id, episode_index, camera, task, frames, fps, duration_seconds, 'videos/' || camera || '/episode-' || pad || '.mp4' AS video_file
FROM hub, LATERAL (VALUES ('front'), ('wrist')) AS c(camera)""",
)
def s13(t):
    return X.hub_media(facts(t), CAMERAS).drop("video").withColumn("duration_seconds", r6(F.col("duration_seconds")))


@query(
    "S14_training_table",
    "fo",
    sql="""
SELECT dataset_id, episode_index, frame_index, round(timestamp, 6) AS timestamp, sample_sequence, captured_at_ns, round(o2, 6) AS q2, round(a0, 6) AS a0,
       CASE WHEN leader_width = 3 THEN round(a2, 6) END AS leader2 FROM fo""",
)
def s14(t):
    return X.training_table(t.frames_orders).select(
        "dataset_id", "episode_index", "frame_index", r6(F.col("timestamp")).alias("timestamp"), "sample_sequence", "captured_at_ns",
        r6(F.get("qpos", F.lit(2)).cast("double")).alias("q2"), r6(F.get("action", F.lit(0)).cast("double")).alias("a0"),
        r6(F.get("leader", F.lit(2)).cast("double")).alias("leader2"),
    )


@query(
    "S14_training_attributes",
    "eps", "ds",
    sql="""
SELECT e.dataset_id, e.episode_index, d.fps, coalesce(nullif(trim(e.task), ''), d.task) AS task, d.robot_type, coalesce(e.units, 'radians') AS units, d.joint_names,
       'gaussian' AS smoothing, 1.5::DOUBLE AS smoothing_strength FROM eps e JOIN ds d ON d.dataset_id = e.dataset_id""",
)
def s14_attributes(t):
    out = X.training_attributes(facts(t), "gaussian", 1.5)
    return out.select(
        "dataset_id", "episode_index", "fps", "task", "robot_type", "units", F.concat_ws(",", "joint_names").alias("joint_names"),
        "smoothing", "smoothing_strength",
    )


@query(
    "S15_write_export",
    "fo",
    sql="SELECT dataset_id, count(*) AS frames, count(*) - 1 AS last_index, 'checked exported exists exported' AS steps FROM fo GROUP BY 1",
)
def s15(t):
    path, kind = scratch(t, "export"), "episode.lerobot-export"
    # Both are written twice, so they are worked out once.
    rows = stage(X.lerobot_frames(t.frames_orders))
    provenance = stage(X.export_manifest(t.datasets, A.export_totals(t.frames_orders, camera_table(t)), kind))
    seen = [
        X.write_export(rows, provenance, path, kind, "check"),
        X.write_export(rows, provenance, path, kind),
        X.write_export(rows, provenance, path, kind),
        X.write_export(rows, provenance, path, kind, overwrite=True),
    ]
    back = X.read_export(t.spark, path)
    return back.groupBy("dataset_id").agg(F.count("*").alias("frames"), F.max("index").alias("last_index")).withColumn(
        "steps", F.lit(" ".join(seen))
    )


@query(
    "S14_training_sources",
    "eps", "ds",
    sql="""
SELECT e.dataset_id, e.episode_index, 'datasets/' || e.dataset_id || '/episodes/episode-' || lpad(CAST(e.episode_index AS VARCHAR), 6, '0') AS source_episode,
       '2024-01-01' AS exported_at, CASE WHEN o_orderkey % 3 = 0 THEN 'F-' || o_orderkey END AS follower, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS known
FROM eps e JOIN ds d ON d.dataset_id = e.dataset_id""",
)
def s14_sources(t):
    """Attributes with the robot's identity and where an episode comes from."""
    key = F.substring("run_id", 5, 20).cast("long")
    none = F.lit(None).cast("string")
    robot = F.struct(
        F.concat(F.lit("L-"), key).alias("leader_hardware_id"), F.when(key % 3 == 0, F.concat(F.lit("F-"), key)).alias("follower_hardware_id"),
        none.alias("leader_calibration_path"), none.alias("follower_calibration_path"),
    )
    out = X.training_attributes(facts(t).withColumn("robot", robot), exported_at=F.lit("2024-01-01"))
    return out.select(
        "dataset_id", "episode_index", "source_episode", "exported_at", F.col("robot")["follower_hardware_id"].alias("follower"), F.size("robot").alias("known"),
    )


def event_sessions(t):
    return A.full_episodes(t.frames_events).select(
        "dataset_id", "episode_index", "frames", F.lit(30.0).alias("fps"), F.lit("radians").alias("units")
    )


@query(
    "S16_to_wire",
    "fe",
    sql="""
SELECT episode_index, frame_index, 'events-demo/' || episode_index AS key, n AS frames, 'action' AS source, round(a0, 4) AS p0, round(a2, 4) AS p2, frame_index AS seq, 'autoplay' AS playback_event
FROM fe""",
)
def s16(t):
    wire = Y.to_wire(Y.wire_rows(t.frames_events, event_sessions(t), "action", F.lit("replay")))
    back = F.from_json(
        "value", "frames bigint, source string, positions array<double>, seq bigint, playback_event string"
    )
    return wire.withColumn("b", back).select(
        "episode_index", "frame_index", "key", F.col("b.frames").alias("frames"), F.col("b.source").alias("source"),
        F.round(F.get("b.positions", F.lit(0)), 4).alias("p0"), F.round(F.get("b.positions", F.lit(2)), 4).alias("p2"),
        F.col("b.seq").alias("seq"), F.col("b.playback_event").alias("playback_event"),
    )


@query(
    "S18_export_manifest",
    "fo", "ds",
    sql="""
SELECT d.dataset_id, 'episode.hub-export' AS kind, 'datasets/' || d.dataset_id AS source, 'demo' AS repo_id, c.episodes, c.frames, 'gaussian' AS smoothing, 1.5::DOUBLE AS smoothing_strength
FROM ds d JOIN (SELECT dataset_id, count(DISTINCT episode_index) AS episodes, count(*) AS frames FROM fo GROUP BY 1) c ON c.dataset_id = d.dataset_id""",
)
def s18(t):
    totals = A.export_totals(t.frames_orders, camera_table(t))
    return X.export_manifest(t.datasets, totals, "episode.hub-export", "demo", "gaussian", 1.5).drop("schema_version", "exported_at")


@query(
    "S18_hub_manifest",
    "hub",
    sql="""
SELECT dataset_id, episode_id, episode_index, frames, 'data/train-' || pad || '.parquet' AS data_file, 'media/videos/front/episode-' || pad || '.mp4' AS front_video, 'media/videos/wrist/episode-' || pad || '.mp4' AS wrist_video FROM hub""",
)
def s18_rows(t):
    return X.hub_manifest_rows(facts(t), CAMERAS).select(
        "dataset_id", "episode_id", "episode_index", "frames", "data_file", *[F.col("videos")[c].alias(f"{c}_video") for c in CAMERAS]
    )


@query(
    "T7_paced_timeline",
    "fe",
    sql="""
SELECT episode_index, frame_index, CAST(loop AS INTEGER) AS loop, loop * n + frame_index AS seq, round((loop * n + frame_index) * (1.0 / (30.0::DOUBLE * 2.0)), 6) AS due_seconds
FROM fe, range(3) AS r(loop)""",
)
def t7(t):
    return Y.paced_timeline(t.frames_events, event_sessions(t), 2.0, 3).select(
        "episode_index", "frame_index", "loop", "seq", r6(F.col("due_seconds")).alias("due_seconds")
    )
