"""Frame tables laid out by key: lookups equal the plain ones and read only what they name."""

import pytest
from pyspark.sql import functions as F

from kinelake.operators import joins as J
from kinelake.operators import projections as P
from kinelake.operators.aggregates import full_episodes
from kinelake.sources import keyed as K


@pytest.fixture(scope="module")
def frames(spark):
    rows = spark.range(900).select(
        F.lit("d").alias("dataset_id"), (F.col("id") % 3 * (F.col("id") % 3 - 1)).alias("episode_index"), F.col("id").alias("n")
    )
    # Episode 0 holds two thirds of all frames.
    number = F.row_number().over(J_window()) - 1
    joints = F.array(F.lit("a"), F.lit("b"))
    vector = F.array(F.col("n").cast("float"), F.lit(1.0).cast("float"))
    return rows.withColumn("frame_index", number.cast("long")).select(
        "dataset_id", "episode_index", "frame_index", joints.alias("joint_names"), vector.alias("action"), vector.alias("observation_state"), vector.alias("leader_state")
    )


def J_window():
    from pyspark.sql import Window

    return Window.partitionBy("dataset_id", "episode_index").orderBy("n")


@pytest.fixture(scope="module")
def keyed(spark, frames, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("keyed"))
    K.write_keyed(frames, root, buckets=16, files=2, run=10)
    return K.read_keyed(spark, root)


def test_every_frame_lies_in_its_bucket(frames, keyed):
    assert keyed.buckets == 16 and keyed.run == 10 and keyed.frames.count() == 900
    assert keyed.frames.where(F.col("bucket") != keyed.bucket()).count() == 0
    assert keyed.frames.where("episode_index = 0").select("bucket").distinct().count() > 12


def test_lookups_equal_the_plain_ones(spark, frames, keyed):
    requests = spark.createDataFrame([("d", 0, 5), ("d", 0, -3), ("d", 2, 10**6), ("d", 9, 0), ("d", 0, 5)], "dataset_id string, episode_index long, frame_index long")
    episodes = full_episodes(frames)
    take = lambda df: sorted((r.episode_index, r.frame_index, r.requested_index, r.action[0]) for r in df.collect())
    found = K.keyed_frame_at(requests, episodes, keyed)
    assert take(found) == take(P.frame_at(frames, requests, episodes)) and len(take(found)) == 4
    assert take(K.keyed_frame_at(requests.limit(0), episodes, keyed)) == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull(bucket" in plan


def test_a_batch_reads_the_buckets_it_names(spark, keyed):
    wanted = spark.createDataFrame([("d", 0, 5), ("d", 0, 7), ("d", 0, 25)], "dataset_id string, episode_index long, frame_index long")
    cut = K.touched(wanted, keyed)
    held = {r[0] for r in wanted.select(keyed.bucket()).distinct().collect()}
    assert K.keyed_lookup(wanted, cut).count() == 3
    read = {r[0] for r in cut.frames.select("bucket").distinct().collect()}
    assert read == held and len(held) <= 2
    plan = cut.frames._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket IN" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert K.touched(wanted.limit(0), keyed).frames.count() == 0


def test_deliveries_equal_the_plain_ones(spark, frames, keyed):
    sessions = full_episodes(frames).withColumn("token", F.concat(F.lit("t"), "episode_index"))
    events = spark.createDataFrame(
        [(1, "t0", 3, "play"), (2, "t2", 10**6, " SEEK"), (3, "t2", 0, "stop"), (4, "zz", 0, "play")], "event_id long, token string, frame_index long, event string"
    )
    publishers = spark.createDataFrame(
        [(1, "t0", None, None, "replay", True), (2, "", "t2", None, "inline", True), (3, "t0", "t0", "t2", "replay", True), (4, "t2", None, None, "replay", False)],
        "publisher_id long, token string, source_token string, lineage_token string, mode string, sync boolean",
    )
    take = lambda df: sorted((r.event_id, r.publisher_id, r.frame_index, r.positions[0]) for r in df.collect())
    found = take(K.keyed_deliveries(events, publishers, sessions, keyed, "action"))
    assert found == take(J.replay_deliveries(events, publishers, sessions, frames, "action")) and len(found) == 4
