"""Episode analysis and verdicts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import aggregates as A
from kinelake.operators import analysis as N
from kinelake.operators import evaluate as E
from kinelake.plans.basics import r6
from kinelake.plans.exchange import scratch
from kinelake.plans.fixtures import JOINTS
from kinelake.plans.registry import cte, query
from kinelake.sources import verdicts as L

RULE = "not grip_slip and array_contains(tags, 'move')"

_CACHE: dict = {}


def analysed(t):
    """Signals of the events episodes, computed once per application and table set (they are staged tables)."""
    key = (t.spark.sparkContext.applicationId, t.root)
    from kinelake.plans.fixtures import still_there

    if key not in _CACHE or not still_there(_CACHE[key][2]):
        _CACHE[key] = E.analyse(t.frames_events)
    return _CACHE[key]


def episode_rows(t):
    return A.full_episodes(t.frames_events).select(
        "dataset_id", "episode_index", F.array(*[F.lit(j) for j in JOINTS]).alias("joint_names"),
        F.concat(F.lit("task-"), F.col("episode_index") % 3).alias("task"),
    )


cte(
    "e1",
    """
SELECT b.episode_index, b.joint, coalesce(max(s.ratio), 0) AS separation,
       coalesce(arg_max(s.edge, s.ratio - s.k * 1e-14), any_value(CASE WHEN b.n < 4 THEN b.mean ELSE (b.lo + b.hi) / 2 END)) AS threshold, any_value(b.n) AS n
FROM e1base b LEFT JOIN e1split s ON s.episode_index = b.episode_index AND s.joint = b.joint AND s.ratio > 0
GROUP BY b.episode_index, b.joint""",
    "e1base", "e1split",
)
cte("e1x", "SELECT episode_index, joint, frame_index, round(v, 9) AS x FROM fel WHERE channel = 'observation'", "fel")
cte(
    "e1base",
    """
SELECT episode_index, joint, count(*) AS n, avg(x) AS mean, var_pop(x) AS variance, round(quantile_cont(x, 0.01), 9) AS lo, round(quantile_cont(x, 0.99), 9) AS hi,
       min(x) = max(x) AS flat
FROM e1x GROUP BY ALL""",
    "e1x",
)
cte(
    "e1split",
    """
SELECT episode_index, joint, k, any_value(edge) AS edge,
       round((count(*) FILTER (x <= edge))::DOUBLE / count(*) * (count(*) FILTER (x > edge))::DOUBLE / count(*)
             * power(avg(x) FILTER (x <= edge) - avg(x) FILTER (x > edge), 2) / any_value(variance), 12) AS ratio
FROM (SELECT x.episode_index, x.joint, x.x, k, variance, CASE WHEN k = 63 THEN hi ELSE lo + k * ((hi - lo) / 63.0::DOUBLE) END AS edge
      FROM e1x x JOIN e1base b ON b.episode_index = x.episode_index AND b.joint = x.joint, range(64) AS r(k)
      WHERE b.n >= 4 AND NOT flat AND hi > lo)
GROUP BY episode_index, joint, k HAVING count(*) FILTER (x <= edge) > 0 AND count(*) FILTER (x > edge) > 0""",
    "e1x", "e1base",
)
cte(
    "e2",
    """
SELECT episode_index, joint AS gripper_index, threshold, separation, n AS frames,
       greatest(0, least(1, separation)) * (0.5 + 0.5 * least(1, (separation - runner) / (separation + 1e-9))) AS confidence
FROM (SELECT *, coalesce(lead(separation) OVER w, 0) AS runner, row_number() OVER w AS rk FROM e1 WINDOW w AS (PARTITION BY episode_index ORDER BY separation DESC, joint))
WHERE rk = 1""",
    "e1",
)
cte(
    "e3",
    """
SELECT *, round(sqrt((CASE WHEN g <> 0 THEN power(o0 - lag(o0) OVER w, 2) ELSE 0 END) + (CASE WHEN g <> 1 THEN power(o1 - lag(o1) OVER w, 2) ELSE 0 END)
              + (CASE WHEN g <> 2 THEN power(o2 - lag(o2) OVER w, 2) ELSE 0 END)), 9) AS vel
FROM (SELECT fe.*, e2.gripper_index AS g, round(CASE gripper_index WHEN 0 THEN o0 WHEN 1 THEN o1 ELSE o2 END, 9) > round(threshold, 9) AS state,
             round(CASE gripper_index WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END, 9) > round(threshold, 9) AS command,
             round(greatest(abs(a0 - o0), abs(a1 - o1), abs(a2 - o2)), 9) AS gap
      FROM fe JOIN e2 ON e2.episode_index = fe.episode_index WHERE e2.frames >= 2)
WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)""",
    "fe", "e2",
)
cte(
    "e4",
    """
SELECT e3.*, c.cut, CASE WHEN frame_index > 0 THEN vel > cut END AS moving
FROM e3 JOIN (SELECT episode_index, round(quantile_cont(vel, 0.6), 9) AS cut FROM e3 WHERE frame_index > 0 GROUP BY 1) c ON c.episode_index = e3.episode_index""",
    "e3",
)
cte(
    "e6",
    """
SELECT e4.*, s.stall_cut, gap > stall_cut AS stall, state <> command AS mismatch,
       coalesce(moving, lead(moving) OVER w) AS mf, lag(state) OVER w AS ps
FROM e4 JOIN (SELECT episode_index, round(greatest(coalesce(quantile_cont(gap, 0.9) FILTER (NOT coalesce(moving, FALSE)), 0) * 2, quantile_cont(gap, 0.95)), 9) AS stall_cut
              FROM e4 GROUP BY 1) s ON s.episode_index = e4.episode_index
WINDOW w AS (PARTITION BY e4.episode_index ORDER BY frame_index)""",
    "e4",
)
cte(
    "e7",
    """
SELECT *, sum(CASE WHEN coalesce(ps <> state, FALSE) OR coalesce(pm <> mf, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS segment,
       mismatch AND count(*) OVER (PARTITION BY episode_index, mismatch, island) >= 3 AS slip
FROM (SELECT *, lag(mf) OVER w AS pm, frame_index - row_number() OVER (PARTITION BY episode_index, mismatch ORDER BY frame_index) AS island FROM e6
      WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index))""",
    "e6",
)
cte(
    "e8",
    """
SELECT *, CASE WHEN start_frame > 0 AND before <> grip THEN 'grip-change' WHEN moving THEN 'move' ELSE 'settle' END AS tag,
       sqrt(CASE WHEN g <> 0 THEN power(l0 - f0, 2) ELSE 0 END + CASE WHEN g <> 1 THEN power(l1 - f1, 2) ELSE 0 END + CASE WHEN g <> 2 THEN power(l2 - f2, 2) ELSE 0 END) AS travel
FROM (SELECT episode_index, CAST(segment AS BIGINT) AS segment, any_value(g) AS g, min(frame_index) AS start_frame, max(frame_index) + 1 AS end_frame,
             avg(CASE WHEN mf THEN 1.0 ELSE 0 END) >= 0.5 AS moving, bool_or(state) AS grip, arg_min(ps, frame_index) AS before,
             arg_min(o0, frame_index) AS f0, arg_min(o1, frame_index) AS f1, arg_min(o2, frame_index) AS f2,
             arg_max(o0, frame_index) AS l0, arg_max(o1, frame_index) AS l1, arg_max(o2, frame_index) AS l2,
             bool_or(slip) AS has_slip, bool_or(stall) AS has_stall FROM e7 GROUP BY episode_index, segment)""",
    "e7",
)
cte(
    "e9",
    """
SELECT f.*, s.n_segments, s.n_move, s.label, t.max_tracking_error
FROM (SELECT episode_index, count(*) AS frames, bool_or(slip) AS grip_slip, count(*) FILTER (slip) AS n_slip, count(*) FILTER (stall) AS n_stall,
             count(*) FILTER (NOT moving) AS n_settle FROM e7 GROUP BY 1) f
JOIN (SELECT episode_index, count(*) AS n_segments, count(*) FILTER (tag = 'move') AS n_move,
             arg_min(tag || '@' || start_frame || '-' || end_frame || CASE WHEN has_slip THEN ' (slip)' ELSE ' (stall)' END, start_frame) FILTER (has_slip OR has_stall) AS label
      FROM e8 GROUP BY 1) s ON s.episode_index = f.episode_index
JOIN (SELECT episode_index, max(greatest(abs(a0 - o0), abs(a1 - o1), abs(a2 - o2))) AS max_tracking_error FROM fe GROUP BY 1) t ON t.episode_index = f.episode_index""",
    "e7", "e8", "fe",
)
cte(
    "e14",
    """
SELECT j.*, CASE WHEN success THEN '' WHEN label IS NOT NULL THEN label WHEN grip_slip THEN 'grip_slip' WHEN n_stall > 0 THEN 'stall' ELSE 'unknown' END AS failed_stage,
       CASE WHEN success THEN 1.0 ELSE greatest(0, 1 - (CASE WHEN grip_slip THEN 0.4::DOUBLE ELSE 0 END + 0.4::DOUBLE * least(1, n_stall::DOUBLE / greatest(1, frames)))) END AS score
FROM (SELECT e9.*, e2.gripper_index, e2.confidence AS gripper_confidence, NOT grip_slip AND n_move > 0 AS success FROM e9 JOIN e2 ON e2.episode_index = e9.episode_index) j""",
    "e9", "e2",
)


@query("E1_otsu", "e1", sql="SELECT episode_index, joint, round(separation, 6) AS separation, round(threshold, 6) AS threshold, n FROM e1")
def e1(t):
    return N.otsu(t.frames_events).select(
        "episode_index", "joint", r6(F.col("separation")).alias("separation"), r6(F.col("threshold")).alias("threshold"), "n"
    )


@query(
    "E2_discover_gripper",
    "e2",
    sql="SELECT episode_index, gripper_index, round(threshold, 6) AS gripper_threshold, round(confidence, 6) AS gripper_confidence FROM e2",
)
def e2(t):
    return analysed(t)[0].grippers.select(
        "episode_index", "gripper_index", r6(F.col("gripper_threshold")).alias("gripper_threshold"),
        r6(F.col("gripper_confidence")).alias("gripper_confidence"),
    )


@query(
    "L4_top_joints",
    "e1",
    sql="""
SELECT episode_index, joint, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY separation DESC, joint) AS rk FROM e1) WHERE rk <= 2""",
)
def l4(t):
    return N.ranked_joints(N.otsu(t.frames_events)).select("episode_index", "joint", "rank")


@query("E3_gripper_state", "e3", sql="SELECT episode_index, frame_index, state, command FROM e3")
def e3(t):
    return analysed(t)[0].frames.select("episode_index", "frame_index", "state", "command")


@query("E4_moving", "e4", sql="SELECT episode_index, frame_index, moving FROM e4 WHERE frame_index > 0")
def e4(t):
    return analysed(t)[0].frames.where("frame_index > 0").select("episode_index", "frame_index", "moving")


@query("E5_grip_slip", "e7", sql="SELECT episode_index, frame_index FROM e7 WHERE slip")
def e5(t):
    return analysed(t)[0].frames.where("slip").select("episode_index", "frame_index")


@query("E6_stall_frames", "e6", sql="SELECT episode_index, frame_index, round(gap, 6) AS gap FROM e6 WHERE stall")
def e6(t):
    return analysed(t)[0].frames.where("stall").select("episode_index", "frame_index", r6(F.col("gap")).alias("gap"))


@query("E7_settle_frames", "e4", sql="SELECT episode_index, frame_index FROM e4 WHERE NOT moving")
def e7(t):
    return analysed(t)[0].frames.where("not moving").select("episode_index", "frame_index")


@query("W7_change_points", "e8", sql="SELECT episode_index, segment, start_frame, end_frame FROM e8")
def w7(t):
    return analysed(t)[1].select("episode_index", "segment", "start_frame", "end_frame")


@query(
    "E8_segments",
    "e8",
    sql="""
SELECT episode_index, start_frame, end_frame, tag, moving, CAST(grip AS INTEGER) AS gripper_state, round(travel, 6) AS travel,
       CASE WHEN g = 0 THEN CASE WHEN round(abs(l2 - f2), 9) > round(abs(l1 - f1), 9) THEN 1 ELSE 0 END
            WHEN g = 1 THEN CASE WHEN round(abs(l2 - f2), 9) > round(abs(l0 - f0), 9) THEN 1 ELSE 0 END
            ELSE CASE WHEN round(abs(l1 - f1), 9) > round(abs(l0 - f0), 9) THEN 1 ELSE 0 END END AS dominant_joint
FROM e8""",
)
def e8(t):
    return analysed(t)[1].select(
        "episode_index", "start_frame", "end_frame", "tag", "moving", "gripper_state", r6(F.col("travel")).alias("travel"),
        "dominant_joint",
    )


@query(
    "A9_fingerprint",
    "e9",
    sql="SELECT episode_index, grip_slip, n_stall, n_segments, n_move, n_slip, n_settle, round(max_tracking_error, 6) AS max_tracking_error FROM e9",
)
def a9(t):
    return analysed(t)[2].select(
        "episode_index", "grip_slip", "n_stall", "n_segments", "n_move", "n_slip", "n_settle",
        r6(F.col("max_tracking_error")).alias("max_tracking_error"),
    )


REFERENCE_SQL = """
WITH u AS (SELECT episode_index, c.feature, c.value, c.ord FROM e9, LATERAL (VALUES ('grip_slip', CASE WHEN grip_slip THEN 1.0::DOUBLE ELSE 0 END, 1), ('n_stall', n_stall::DOUBLE, 2),
           ('n_segments', n_segments::DOUBLE, 3), ('max_tracking_error', max_tracking_error, 4), ('n_move', n_move::DOUBLE, 5)) AS c(feature, value, ord)),
r AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM u WHERE episode_index IN (SELECT episode_index FROM e9 WHERE NOT grip_slip) GROUP BY 1)
"""


def reference(t):
    features = analysed(t)[2]
    return A.build_reference(features, features.where(~F.col("grip_slip")))


@query("A8_build_reference", "e9", sql=REFERENCE_SQL + "SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, n FROM r")
def a8(t):
    return reference(t).select("feature", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "n")


@query(
    "D5_feature_overlap",
    "e9",
    sql=REFERENCE_SQL + "SELECT feature, feature <> 'n_move' AS overlap FROM r UNION ALL SELECT 'task-' || (episode_index % 3), FALSE FROM (SELECT DISTINCT episode_index % 3 AS episode_index FROM fe)",
)
def d5(t):
    known = reference(t)
    tasks = t.frames_events.select(F.col("task").alias("feature")).distinct()
    other = known.where("feature <> 'n_move'").select("feature").unionByName(tasks)
    return A.feature_overlap(known, other)


JUDGE_REF_SQL = REFERENCE_SQL + """,
z AS (SELECT u.episode_index, u.feature, u.ord, CASE WHEN r.std > 1e-9 THEN abs(u.value - r.mean) / r.std WHEN abs(u.value - r.mean) <= 1e-9 THEN 0 ELSE 1e6 END AS z
      FROM u JOIN r ON r.feature = u.feature),
w AS (SELECT episode_index, z AS worst, feature FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY z DESC, ord) AS rk FROM z) WHERE rk = 1)
SELECT episode_index, worst <= 2.0 AS success, round(least(1, abs(worst - 2.0) / 2.0), 6) AS judge_confidence, feature AS driver, 'reference' AS rater FROM w"""


@query("E9_judge_reference", "e9", sql=JUDGE_REF_SQL)
def e9(t):
    return E.judge_reference(analysed(t)[2], reference(t), 2.0).select(
        "episode_index", "success", r6(F.col("judge_confidence")).alias("judge_confidence"), "driver", "rater"
    )


@query("U2_reference_argument", "e9", sql=JUDGE_REF_SQL)
def u2(t):
    return E.judge(analysed(t)[2], None, reference(t), 2.0).select(
        "episode_index", "success", r6(F.col("judge_confidence")).alias("judge_confidence"), "driver", "rater"
    )


@query(
    "E10_judge_rule",
    "e9",
    sql="""
SELECT episode_index, NOT grip_slip AND n_move > 0 AS success, 1.0::DOUBLE AS judge_confidence,
       'rule `not grip_slip and array_contains(tags, ''move'')` -> ' || CASE WHEN NOT grip_slip AND n_move > 0 THEN 'True' ELSE 'False' END AS reason FROM e9""",
)
def e10(t):
    return E.judge_rule(analysed(t)[2], RULE).select("episode_index", "success", "judge_confidence", "reason")


@query(
    "E10_rule_faults",
    "e9",
    sql="""
SELECT episode_index, CASE WHEN n_move = 0 THEN NULL ELSE n_stall::DOUBLE / n_move > 1 END AS success, CASE WHEN n_move = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS judge_confidence FROM e9""",
)
def e10_faults(t):
    """A rule that divides by zero on some episodes."""
    return E.judge_rule(analysed(t)[2], "n_stall / n_move > 1").select("episode_index", "success", "judge_confidence")


@query(
    "E10_rule_evidence",
    "e9", "fe",
    sql="""
SELECT f.episode_index, e9.episode_index IS NULL AS insufficient_data, coalesce(n_segments, 0) > 0 AS success
FROM (SELECT DISTINCT episode_index FROM fe) f LEFT JOIN e9 ON e9.episode_index = f.episode_index""",
)
def e10_evidence(t):
    """A rule over everything a rule may name; what it counts in the lists agrees with the counts for every episode."""
    rule = (
        "size(segments) = n_segments and size(ordered_tags) = n_segments and size(slip_frames) = n_slip and size(stall_frames) = n_stall"
        " and size(settle_frames) = n_settle and n_segments > 0 and array_sort(array_distinct(ordered_tags)) = tags"
        " and coalesce(array_max(map_values(tracking_error)), 0.0D) = max_tracking_error and segments[0].start_frame = 0"
    )
    return E.evaluate_analysed(analysed(t), episode_rows(t), rule).select("episode_index", "insufficient_data", "success")


@query(
    "U1_rule_argument",
    "e9",
    sql="SELECT episode_index, n_stall * 20 < frames AND max_tracking_error < 4 AS success, 'expression' AS rater FROM e9",
)
def u1(t):
    judged = E.judge(analysed(t)[2], "n_stall * 20 < frames and max_tracking_error < 4")
    return judged.select("episode_index", "success", "rater")


@query(
    "E11_judge_none",
    "e9",
    sql="SELECT episode_index, NULL::BOOLEAN AS success, 0.0::DOUBLE AS judge_confidence, 'none' AS rater, 'no criterion given' AS reason FROM e9",
)
def e11(t):
    return E.judge(analysed(t)[2]).select("episode_index", "success", "judge_confidence", "rater", "reason")


def verdicts(t):
    return E.evaluate_analysed(analysed(t), episode_rows(t), RULE)


@query("E12_failed_stage", "e14", sql="SELECT episode_index, failed_stage FROM e14")
def e12(t):
    _, rows, features = analysed(t)
    return E.failed_stage(E.judge_rule(features, RULE), rows).select("episode_index", "failed_stage")


@query("E13_score", "e14", sql="SELECT episode_index, round(score, 6) AS score FROM e14")
def e13(t):
    judged = E.judge_rule(analysed(t)[2], RULE)
    return judged.select("episode_index", r6(E.score()).alias("score"))


E14_SQL = """
SELECT episode_index, success, round(score, 6) AS score, failed_stage, round(least(1, gripper_confidence), 6) AS confidence,
       CASE gripper_index WHEN 0 THEN 'shoulder' WHEN 1 THEN 'elbow' ELSE 'gripper' END AS gripper_joint, 'task-' || (episode_index % 3) AS task, FALSE AS insufficient_data
FROM e14"""


@query("E14_evaluate", "e14", sql=E14_SQL)
def e14(t):
    out = E.evaluate(t.frames_events, episode_rows(t), RULE)
    return out.select(
        "episode_index", "success", r6(F.col("score")).alias("score"), "failed_stage",
        r6(F.col("confidence")).alias("confidence"), "gripper_joint", "task", "insufficient_data",
    )


@query(
    "E15_insufficient_data",
    "fo", "eps",
    sql="""
SELECT e.dataset_id, e.episode_index, coalesce(c.n, 0) AS frames, coalesce(c.n, 0) < 2 AS insufficient_data
FROM eps e LEFT JOIN (SELECT dataset_id, episode_index, count(*) AS n FROM fo GROUP BY ALL) c ON c.dataset_id = e.dataset_id AND c.episode_index = e.episode_index""",
)
def e15(t):
    out = E.evaluate(t.frames_orders, t.episodes.select("dataset_id", "episode_index", "joint_names", "task"), RULE)
    return out.select("dataset_id", "episode_index", "frames", "insufficient_data")


# --- statistics over verdicts -------------------------------------------------------------------------------------

cte(
    "vd",
    """
SELECT episode_index, CASE WHEN episode_index % 7 = 0 THEN NULL ELSE success END AS success, CASE WHEN episode_index % 7 = 0 THEN '' ELSE failed_stage END AS failed_stage
FROM e14 WHERE episode_index % 10 <> 0""",
    "e14",
)


def given_verdicts(t):
    """Verdicts as stored: some episodes never evaluated, some without a decision."""
    open_case = F.col("episode_index") % 7 == 0
    return verdicts(t).where("episode_index % 10 <> 0").select(
        "dataset_id", "episode_index", F.when(~open_case, F.col("success")).alias("success"),
        F.when(open_case, "").otherwise(F.col("failed_stage")).alias("failed_stage"),
    )


@query(
    "A6_episode_stats",
    "vd", "e14",
    sql="""
SELECT 'events-demo' AS dataset_id, (SELECT count(*) FROM e14) AS attempts, count(*) AS evaluated, count(*) FILTER (success) AS successes,
       round((count(*) FILTER (success))::DOUBLE / count(*), 6) AS success_rate FROM vd""",
)
def a6(t):
    return A.episode_stats(episode_rows(t), given_verdicts(t)).select(
        "dataset_id", "attempts", "evaluated", "successes", r6(F.col("success_rate")).alias("success_rate")
    )


FAILURES_SQL = """
SELECT 'events-demo' AS dataset_id, failed_stage AS stage, count(*) AS count, min(episode_index) AS first_episode
FROM vd WHERE NOT coalesce(success, FALSE) AND failed_stage <> '' GROUP BY 2"""


@query("A7_failure_breakdown", "vd", sql=FAILURES_SQL)
def a7(t):
    return A.failure_breakdown(given_verdicts(t))


@query(
    "L3_top_failure",
    "vd",
    sql=f"SELECT dataset_id, stage, count FROM ({FAILURES_SQL}) ORDER BY count DESC, first_episode LIMIT 1",
)
def l3(t):
    return A.top_failure(given_verdicts(t))


@query(
    "S17_write_back",
    "vd", "fe",
    sql="""
SELECT f.episode_index, 'task-' || (f.episode_index % 3) AS task, CASE WHEN f.episode_index % 2 = 0 THEN true ELSE vd.success END AS success,
       CASE WHEN f.episode_index % 2 = 0 THEN 'second' ELSE vd.failed_stage END AS failed_stage
FROM (SELECT DISTINCT episode_index FROM fe) f LEFT JOIN vd ON vd.episode_index = f.episode_index WHERE vd.episode_index IS NOT NULL OR f.episode_index % 2 <> 0
UNION ALL SELECT DISTINCT fe.episode_index, 'task-' || (fe.episode_index % 3), NULL, NULL FROM fe LEFT JOIN vd ON vd.episode_index = fe.episode_index WHERE vd.episode_index IS NULL AND fe.episode_index % 2 = 0""",
)
def s17_write_back(t):
    """Verdicts written, those of every second episode written again, the log compacted and read with its episodes."""
    root = scratch(t, "verdicts")
    given = given_verdicts(t).withColumn("ts", F.lit(2.0))
    L.write_back(given, root)
    # A later revision counts although its clock lies before.
    again = given.where("episode_index % 2 = 0").withColumns({"success": F.lit(True), "failed_stage": F.lit("second"), "ts": F.lit(1.0)})
    L.write_back(again, root)
    L.compact(t.spark, root)
    out = L.with_evaluation(episode_rows(t), root)
    return out.select(
        "episode_index", "task", F.col("evaluation.success").alias("success"), F.col("evaluation.failed_stage").alias("failed_stage")
    )


@query(
    "S17_with_verdicts",
    "vd", "fe",
    sql="""
SELECT f.episode_index, 'task-' || (f.episode_index % 3) AS task, vd.success, vd.failed_stage
FROM (SELECT DISTINCT episode_index FROM fe) f LEFT JOIN vd ON vd.episode_index = f.episode_index""",
)
def s17(t):
    now = given_verdicts(t).withColumn("ts", F.lit(2.0))
    older = now.withColumns({"success": F.lit(True), "failed_stage": F.lit("older"), "ts": F.lit(1.0)})
    out = E.with_verdicts(episode_rows(t), now.unionByName(older))
    return out.select(
        "episode_index", "task", F.col("evaluation.success").alias("success"),
        F.col("evaluation.failed_stage").alias("failed_stage"),
    )
