"""A clean and a slipping pick: discovery, slips, verdicts and statistics."""

import pytest
from pyspark.sql import functions as F

from kinelake.operators import aggregates as A
from kinelake.operators import analysis as N
from kinelake.operators import evaluate as E

SCHEMA = "dataset_id string, episode_index bigint, frame_index bigint, observation_state array<float>, action array<float>"


def pick(episode, slip):
    rows = []
    for t in range(60):
        reach = min(t, 20) / 20 + max(0, min(t - 20, 20)) / 40
        grip = 0.9 if t < 20 or t == 59 else 0.05
        held = 0.9 if slip and 40 <= t < 59 else grip
        arm = [reach, 0.5 * reach]
        rows.append(("d", episode, t, [*arm, held], [*arm, grip]))
    return rows


@pytest.fixture(scope="module")
def analysed(spark):
    frames = spark.createDataFrame(
        [r for e in range(5) for r in pick(e, False)] + pick(5, True) + [("d", 6, 0, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0])], SCHEMA
    )
    return E.analyse(frames)


@pytest.fixture(scope="module")
def episodes(spark):
    return spark.createDataFrame(
        [("d", e, ["a", "b", "gripper"], "pick") for e in range(7)],
        "dataset_id string, episode_index bigint, joint_names array<string>, task string",
    )


def test_gripper_is_found_and_slip_seen(analysed):
    signals, _, features = analysed
    found = {r.episode_index: r for r in signals.grippers.collect()}
    assert all(found[e].gripper_index == 2 for e in range(6)) and found[0].gripper_confidence > 0.5
    slips = {r.episode_index: r for r in features.collect()}
    assert not slips[0].grip_slip and slips[5].grip_slip and slips[5].n_slip == 19
    assert 6 not in slips


def test_arm_only_episode_is_ambiguous(spark):
    rows = [("d", 0, t, [t / 60, 1 - t / 60, 0.3 * t / 60], [0.0] * 3) for t in range(60)]
    assert N.discover_gripper(N.otsu(spark.createDataFrame(rows, SCHEMA))).first().gripper_confidence < 0.5


def test_rule_verdicts_and_statistics(analysed, episodes):
    out = {r.episode_index: r for r in E.evaluate_analysed(analysed, episodes, "not grip_slip").collect()}
    assert out[0].success and out[0].score == 1.0 and out[0].failed_stage == "" and out[0].gripper_joint == "gripper"
    assert out[5].success is False and out[5].failed_stage.endswith("(slip)") and out[5].score <= 0.6
    assert out[6].insufficient_data and out[6].frames == 1
    verdicts = E.evaluate_analysed(analysed, episodes, "not grip_slip").where("episode_index < 6")
    stats = A.episode_stats(episodes, verdicts).first()
    assert (stats.attempts, stats.evaluated, stats.successes) == (7, 6, 5)
    top = A.top_failure(verdicts).first()
    assert top.stage == out[5].failed_stage and top["count"] == 1


def test_no_criterion_and_bad_rule_give_no_verdict(analysed, episodes):
    none = E.evaluate_analysed(analysed, episodes).first()
    assert none.success is None and none.confidence == 0.0 and none.score == 0.0
    bad = E.judge_rule(analysed[2], "no_such_signal > 1").first()
    assert bad.success is None and bad.reason.startswith("rule error")
    assert E.judge_rule(analysed[2], "not (").first().success is None


def test_reference_outlier(analysed):
    features = analysed[2]
    reference = A.build_reference(features, features.where("episode_index < 5"))
    out = {r.episode_index: r for r in E.judge_reference(features, reference).collect()}
    assert out[0].success and out[5].success is False and out[5].driver == "grip_slip"


def test_a_rule_may_name_frames_segments_and_joints(analysed, episodes):
    rule = "slip_frames[0] = 40 and ordered_tags[0] <> 'settle' and size(stall_frames) = n_stall and tracking_error[2] > 0.8 and segments[0].start_frame = 0"
    out = {r.episode_index: r for r in E.evaluate_analysed(analysed, episodes, rule).collect()}
    assert out[5].success and out[5].reason.startswith("rule `slip_frames[0] = 40")
    lists = {r.episode_index: r for r in E.rule_evidence("slip_frames segments settle_frames", analysed[0].frames, analysed[1]).collect()}
    assert lists[5].slip_frames == list(range(40, 59)) and lists[0].slip_frames == [] and 0 not in lists[0].settle_frames
    starts = [s.start_frame for s in lists[5].segments]
    assert starts == sorted(starts) and starts[0] == 0 and lists[5].segments[-1].end_frame == 60
    assert E.rule_evidence("not grip_slip", analysed[0].frames, analysed[1]) is None


def test_reference_gives_a_distance_for_each_feature(spark, analysed):
    features = analysed[2]
    reference = spark.createDataFrame([("grip_slip", 0.0, 0.0), ("n_move", 1.0, 1.0)], "feature string, mean double, std double")
    out = {r.episode_index: r for r in E.judge_reference(features, reference).collect()}
    assert out[0].z_scores.keys() == {"grip_slip", "n_move"} and out[5].z_scores["grip_slip"] == 1e6 and out[5].success is False
    nothing = E.judge_reference(features, reference.limit(0)).first()
    assert nothing.success is None and nothing.reason == "reference has no features"
    other = E.judge_reference(features, reference.withColumn("feature", F.lit("unheard"))).first()
    assert other.reason == "reference shares no feature" and other.z_scores is None


def test_splits_do_not_depend_on_the_size_of_an_episode(spark):
    """Series in one task and counted rows give the same splits: bimodal, flat, short, ragged, missing and far values."""
    import numpy as np

    from kinelake.session import HOT_ROWS_CONF

    rng = np.random.default_rng(3)
    rows = []
    for e in range(6):
        for t in range(90 + e):
            both = float(rng.normal(0.1 if rng.random() < 0.3 + e / 20 else 0.8, 0.05))
            vector = [both, 0.25, float(rng.normal() * 10 ** (e - 2)), float(round(rng.random(), 1))]
            rows.append(("d", e, t, vector[: 3 if t % 7 == 0 and e == 2 else 4], [0.0]))
    rows += [("d", 7, t, [1.0 + t], [0.0]) for t in range(3)] + [("d", 8, 0, None, [0.0]), ("d", 9, 0, [], [0.0]), ("d", 10, 0, [2.5], [0.0])]
    frames = spark.createDataFrame(rows, SCHEMA).repartition(3)
    take = lambda df: {(r.episode_index, r.joint): (r.separation, r.threshold, r.n) for r in df.collect()}
    series, counted = take(N._otsu_series(frames)), take(N._otsu_counted(frames))
    spark.conf.set(HOT_ROWS_CONF, "92")
    try:
        mixed = take(N.otsu(frames))
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert series.keys() == counted.keys() == mixed.keys() and len(series) == 26
    for k, (separation, threshold, n) in counted.items():
        for other in (series[k], mixed[k]):
            assert other[2] == n and abs(other[0] - separation) < 1e-9 and abs(other[1] - threshold) < 1e-9
    assert series[0, 0][0] > 0.8 and series[0, 1][0] == 0
