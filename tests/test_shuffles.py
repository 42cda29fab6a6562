"""What is shuffled, read from plans before they run."""

import re

import pytest

from kinelake.operators import quality as Q
from kinelake.plans import exchange, fixtures
from kinelake.sources import export as X

ROOT = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"\bExchange hashpartitioning", plan(df)))


@pytest.fixture
def merged(spark):
    """Joins as on large tables, where no side is small enough to be sent to all; repeats of a plan count once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def frames(spark, n=6):
    rows = [("d", e, 2 * f, float(f if e != 1 or f < 3 else 0), ["a", "b"], [1.0, 2.0], [1.0, 2.0] if e != 2 else [1.0], [1.0, 2.0]) for e in range(3) for f in range(n)]
    names = "dataset_id string, episode_index long, frame_index long, timestamp float, joint_names array<string>"
    return spark.createDataFrame(rows, names + ", observation_state array<float>, action array<float>, leader_state array<float>")


def test_journals_shuffle_open_recordings_only(spark, merged):
    """lines of closed recordings go before the join, and nothing counts them."""
    text = plan(exchange._journal_lines(fixtures.Tables(spark, ROOT)))
    assert re.search(r"Filter [^\n]*l_orderkey#\d+L? % 50\) = 0", text)


def test_orders_are_shuffled_without_what_their_dataset_knows(spark, merged, capsys):
    """texts of the dataset join after the last shuffle."""
    fixtures.Tables.orders.func.build(fixtures.Tables(spark, ROOT)).explain("formatted")
    shuffled = re.findall(r"Exchange *\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning", capsys.readouterr().out)
    assert any("n_nationkey" in columns for columns in shuffled) and not any("robot_type" in columns for columns in shuffled)


def test_short_episodes_are_exported_in_one_shuffle(spark, merged):
    """F16: numbering and offsets share the shuffle of the frames; the other one is that of the offsets, a row per episode."""
    rows = X.lerobot_frames(frames(spark))
    assert shuffles(rows) == 2
    found = sorted((r.episode_index, r.frame_index, r["index"]) for r in rows.collect())
    assert found == [(e, f, 6 * e + f) for e in range(3) for f in range(6)]


def test_short_and_long_episodes_check_alike(spark):
    """one pass over slim rows; with blocks shorter than an episode the blocked way says the same."""
    held = {}
    for rows in ("8192", "2"):
        spark.conf.set("spark.kinelake.blockRows", rows)
        held[rows] = sorted(tuple(bool(v) if k in ("_off", "_late") else v for k, v in r.asDict().items()) for r in Q.episode_checks(frames(spark)).collect())
    spark.conf.unset("spark.kinelake.blockRows")
    assert held["8192"] == held["2"] == [("d", 0, 6, False, False), ("d", 1, 6, False, True), ("d", 2, 6, True, False)]


def test_a_report_works_out_violations_once(spark, merged):
    """datasets without any take part without a second pass."""
    violations = spark.createDataFrame([("a", "error"), ("a", "warning"), ("c", "warning")], "dataset_id string, severity string")
    datasets = spark.createDataFrame([("a",), ("b",)], "dataset_id string")
    report = Q.validation_report(datasets, violations)
    assert shuffles(report) == 1
    assert sorted(tuple(r) for r in report.collect()) == [("a", 1, 1, False), ("b", 0, 0, True), ("c", 0, 1, True)]
