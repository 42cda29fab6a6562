"""Tables that change together, saving of recorded runs, crashes in between."""

import json

import pytest
from pyspark.sql import functions as F

from kinelake.sources import commits
from kinelake.sources import journals as R

FRESH = "dataset_id string, joint_names array<string>"
RUNS = "run_id string, dataset_id string, fps int, task string, started_at string"


def line(run, i, names=("a", "b"), camera=None, **robot):
    values = dict.fromkeys(names, i / 10)
    body = {"kind": "episode.teleoperation-sample", "sequence": i, "joint_names": list(names), "observation": values, "action": values, **robot}
    return json.dumps({"frame_index": i, "timestamp": i / 10, "task": "t", "robot": body, "cameras": camera or {}, "run_id": run})


@pytest.fixture
def recorded(spark, tmp_path):
    lines = [line("r1", i, leader_hardware_id="L" if i == 0 else "x", camera={"front": {"sequence": i, "captured_at_ns": 5, "fx": "3.5"}}) for i in range(3)]
    lines += [line("r2", i) for i in range(2)] + [line("r3", 0), line("r3", 1, ("b", "a"))] + [line("r5", 0, ("b", "a"))]
    (tmp_path / "journal.json").write_text("\n".join([*lines, "", "{broken"]))
    runs = [("r1", "d", 10, "t", "2024-01-02"), ("r2", "d", 10, None, "2024-01-01"), ("r3", "d", 10, "t", "2024-01-01"), ("r4", "d", 10, "t", "2024-01-01"), ("r5", "d", 10, "t", "2024-01-03"), ("r6", "e", 10, "t", "2024-01-01")]
    return R.read_journal(spark, str(tmp_path / "journal.json")), spark.createDataFrame(runs, RUNS), spark.createDataFrame([("d", None), ("e", None)], FRESH)


def ask(spark, *pairs):
    return spark.createDataFrame([("e" if r == "r6" else "d", r, a) for r, a in pairs], "dataset_id string, run_id string, action string")


EVERY = [("r1", "save"), ("r2", "SAVE "), ("r3", "save"), ("r4", "save"), ("r5", "finalize"), ("r6", "discard"), ("r7", "save"), ("r1", "keep")]


def content(spark, root):
    out = {}
    for name, table in R.saved_tables(spark, root).items():
        timeless = table.drop("saved_at", "completed_at", "closed_at")
        out[name] = sorted(timeless.select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0].tolist())
    return out


def test_saved_runs_have_frames_episode_and_manifest_entry(spark, recorded, tmp_path):
    root = str(tmp_path / "store")
    held, result = R.close_runs(*recorded, ask(spark, *EVERY), root)
    status = {(r.run_id, r.action): (r.status, r.episode_index) for r in result.collect()}
    assert status == {
        ("r1", "save"): ("saved", 1), ("r2", "SAVE "): ("saved", 0),
        ("r3", "save"): ("joint order changes within the run", None),
        ("r4", "save"): ("episode without frames not saved", None), ("r5", "finalize"): ("joint order is not that of the saved episodes", None),
        ("r6", "discard"): ("discarded", None), ("r7", "save"): ("no such unfinished episode", None),
        ("r1", "keep"): ("unknown action, choose save, finalize or discard", 1),
    }
    assert held.version == 0
    saved = R.saved_tables(spark, root)
    assert sorted((r.episode_index, r.frame_index) for r in saved["frames"].collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    episode = {r.run_id: r for r in saved["episodes"].collect()}
    assert episode["r1"].robot.leader_hardware_id == "L" and episode["r1"].cameras == {"front": {"fx": "3.5"}}
    assert episode["r1"].duration_seconds == 0.3 and episode["r2"].task == "" and episode["r1"].kind == "episode.info"
    assert {r.path for r in saved["manifest"].collect()} == {"episodes/episode-000000", "episodes/episode-000001"}
    assert sorted(r.run_id for r in saved["closed"].collect()) == ["r1", "r2", "r6"]
    assert R.dataset_features(saved["episodes"]).collect()[0].joint_names == ["a", "b"]
    # Later ones are numbered on; a different joint order is still refused; nothing to do makes no version.
    before = content(spark, root)
    again, result = R.close_runs(*recorded, ask(spark, *EVERY), root)
    assert again.version == 0 and content(spark, root) == before
    assert {r.run_id: r.status for r in result.where("run_id in ('r2', 'r6')").collect()} == {"r2": "no such unfinished episode", "r6": "no such unfinished episode"}


def test_episodes_are_numbered_on_across_calls(spark, recorded, tmp_path):
    root = str(tmp_path / "store")
    R.close_runs(*recorded, ask(spark, ("r1", "save")), root)
    held, result = R.close_runs(*recorded, ask(spark, ("r2", "save")), root)
    assert held.version == 1 and [(r.status, r.episode_index) for r in result.collect()] == [("saved", 1)]
    assert commits.snapshot(spark, root, 0).read(spark, "episodes", R.EPISODE_INFO).count() == 1
    with pytest.raises(ValueError, match="no version 7"):
        commits.snapshot(spark, root, 7)


class Lost(Exception):
    pass


def test_a_job_lost_between_any_two_writes_may_be_repeated(spark, recorded, tmp_path, monkeypatch):
    root, clean = str(tmp_path / "store"), str(tmp_path / "clean")
    R.close_runs(*recorded, ask(spark, *EVERY), clean)
    done = []

    def counted(function, most):
        def step(*args, **more):
            if len(done) == most:
                raise Lost
            done.append(function.__name__)
            return function(*args, **more)

        return step

    # Lost before each of the four tables, then before the record, always over what the lost ones left.
    for writes in range(5):
        done.clear()
        with monkeypatch.context() as patched:
            patched.setattr(commits, "write_table", counted(commits.write_table, writes))
            patched.setattr(commits, "create", counted(commits.create, writes))
            with pytest.raises(Lost):
                R.close_runs(*recorded, ask(spark, *EVERY), root)
        assert len(done) == writes and commits.versions(spark, root) == []
    R.close_runs(*recorded, ask(spark, *EVERY), root)
    assert content(spark, root) == content(spark, clean)
    assert len(commits.sweep(spark, root)) == 0 + 1 + 2 + 3 + 4 and commits.sweep(spark, root) == []
    assert content(spark, root) == content(spark, clean)


def test_of_two_writers_the_second_numbers_again(spark, recorded, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    original, raced = commits.create, []

    def slow(session, path, text):
        if not raced:
            raced.append(path)
            R.close_runs(*recorded, ask(spark, ("r2", "save")), root)
        return original(session, path, text)

    monkeypatch.setattr(commits, "create", slow)
    held, result = R.close_runs(*recorded, ask(spark, ("r1", "save")), root)
    assert held.version == 1 and result.first().episode_index == 1
    assert sorted((r.run_id, r.episode_index) for r in R.saved_tables(spark, root)["episodes"].collect()) == [("r1", 1), ("r2", 0)]
    assert len(commits.sweep(spark, root, keep=2)) == 4


def test_tables_replaced_and_kept(spark, tmp_path):
    root = str(tmp_path / "store")
    one = commits.commit(spark, commits.snapshot(spark, root), {"x": spark.range(3), "y": spark.range(2)}, notes={"kind": "k"})
    two = commits.commit(spark, one, {"x": spark.range(1)}, replace=("x",))
    assert two.read(spark, "x", "id long").count() == 1 and two.read(spark, "y", "id long").count() == 2 and two.notes == {"kind": "k"}
    assert commits.snapshot(spark, root, 0).read(spark, "x", "id long").count() == 3
    with pytest.raises(commits.Conflict):
        commits.commit(spark, one, {"x": spark.range(9)})
    assert commits.versions(spark, root) == [0, 1] and two.read(spark, "z", "id long").count() == 0


# --- exports ---------------------------------------------------------------------------------------------------------

PROVENANCE = "dataset_id string, kind string"


def export(spark, path, rows, **more):
    from kinelake.sources import export as X

    return X.write_export(rows, spark.createDataFrame([("d", "k"), ("d", "other")], PROVENANCE), path, "k", **more)


def test_a_failed_overwrite_leaves_the_old_export_readable(spark, tmp_path):
    from kinelake.sources import export as X

    path = str(tmp_path / "out")
    assert export(spark, path, spark.range(3), action="check") == "checked" and not (tmp_path / "out").exists()
    assert export(spark, path, spark.range(3)) == "exported" and export(spark, path, spark.range(9)) == "exists"
    broken = spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        export(spark, path, broken, overwrite=True)
    assert X.read_export(spark, path).count() == 3
    assert export(spark, path, {"data": spark.range(5), "stats": spark.range(1)}, overwrite=True) == "exported"
    assert X.read_export(spark, path).count() == 5 and X.read_export(spark, path, "stats").count() == 1
    assert X.read_export(spark, path, version=0).count() == 3 and X.read_export(spark, path, "provenance").count() == 1
    commits.sweep(spark, path)
    assert X.read_export(spark, path).count() == 5
    with pytest.raises(ValueError, match="no version 0"):
        X.read_export(spark, path, version=0)


def test_an_export_names_every_violation_and_spares_other_data(spark, tmp_path):
    from kinelake.sources import export as X

    rows = [("d", 1, "V4", "error", "one"), ("d", None, "V8", "warning", "w"), ("d", 0, "V5", "error", "two"), ("c", 0, "V1", "error", "three")]
    found = spark.createDataFrame(rows, "dataset_id string, episode_index long, rule string, severity string, message string")
    with pytest.raises(X.ExportRefused, match="three; two; one") as refused:
        export(spark, str(tmp_path / "out"), spark.range(3), violations=found)
    assert refused.value.violations.count() == 3
    assert export(spark, str(tmp_path / "out"), spark.range(3), violations=found.where("severity = 'warning'")) == "exported"
    spark.range(2).write.parquet(str(tmp_path / "table"))
    with pytest.raises(ValueError, match="another kind"):
        export(spark, str(tmp_path / "table"), spark.range(3), overwrite=True)
    with pytest.raises(ValueError, match="another kind"):
        X.write_export(spark.range(1), spark.createDataFrame([("d", "other")], PROVENANCE), str(tmp_path / "out"), "other", overwrite=True)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2 and X.read_export(spark, str(tmp_path / "out")).count() == 3


# --- verdicts --------------------------------------------------------------------------------------------------------


def test_the_last_verdict_counts_and_nothing_else_changes(spark, tmp_path):
    from kinelake.sources import verdicts as L

    root = str(tmp_path / "log")
    episodes = spark.createDataFrame([("d", i, f"task {i}") for i in range(3)], "dataset_id string, episode_index long, task string")
    assert [r.evaluation for r in L.with_evaluation(episodes, root).collect()] == [None] * 3
    kind = "dataset_id string, episode_index long, success boolean, score double, ts double"
    L.write_back(spark.createDataFrame([("d", 0, True, 1.0, 9.0), ("d", 1, False, 0.2, 9.0)], kind), root)
    L.write_back(spark.createDataFrame([("d", 1, None, 0.5, 1.0)], kind), root)

    def verdicts(version=None):
        rows = L.with_evaluation(episodes, root, version).orderBy("episode_index").collect()
        assert [r.task for r in rows] == ["task 0", "task 1", "task 2"]
        return [None if r.evaluation is None else (r.evaluation.success, r.evaluation.score) for r in rows]

    assert verdicts() == [(True, 1.0), (None, 0.5), None] and verdicts(0) == [(True, 1.0), (False, 0.2), None]
    held = L.compact(spark, root)
    assert held.version == 2 and verdicts() == [(True, 1.0), (None, 0.5), None] and L.revisions(spark, root).count() == 2
    assert L.compact(spark, root).version == 2
    commits.sweep(spark, root)
    L.write_back(spark.createDataFrame([("d", 0, False, 0.0, 0.0)], kind), root)
    assert verdicts() == [(False, 0.0), (None, 0.5), None]
