"""Block-wise primitives against plain windows, with one group holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelake.operators import blocks as B
from kinelake.operators import windows as W
from kinelake.operators.blocks import carry, dense_index, exact_quantiles, frame_block, running_total
from kinelake.session import HOT_ROWS_CONF

KEYS = ["dataset_id", "episode_index"]


@pytest.fixture(scope="module")
def table(spark):
    random.seed(1)
    rows = []
    for e, n in ((0, 400), (1, 7), (2, 1), (3, 60)):
        for i in range(n):
            rows.append(("d", e, i, random.choice([None, random.gauss(0, 1)]), random.random() < 0.6))
    return spark.createDataFrame(rows, "dataset_id string, episode_index bigint, frame_index bigint, v double, m boolean").cache()


def test_running_total_index_and_carry(table, small_blocks):
    whole = Window.partitionBy(*KEYS).orderBy("frame_index")
    plain = table.select(
        *KEYS, "frame_index",
        F.sum(F.col("m").cast("long")).over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("t"),
        F.last("v", True).over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("b"),
        F.first("v", True).over(whole.rowsBetween(0, Window.unboundedFollowing)).alias("a"),
        (F.row_number().over(whole) - 1).cast("long").alias("i"),
    )
    block = frame_block(table)
    out = running_total(table, KEYS, ["frame_index"], block, F.col("m").cast("long"), "t")
    out = carry(out, KEYS, ["frame_index"], block, {"b": F.col("v")})
    out = carry(out, KEYS, ["frame_index"], block, {"a": F.col("v")}, forward=False)
    out = dense_index(out, KEYS, ["frame_index"], block, "i").select(*KEYS, "frame_index", "t", "b", "a", "i")
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_runs(table, small_blocks):
    got = sorted((r.episode_index, r.first_frame, r.last_frame, r.length) for r in W.runs(table, "m").collect())
    want, current = [], None
    for r in sorted(table.collect(), key=lambda r: (r.episode_index, r.frame_index)):
        if r.m and current and current[0] == r.episode_index and current[2] == r.frame_index - 1:
            current[2] = r.frame_index
        elif r.m:
            current = [r.episode_index, r.frame_index, r.frame_index]
            want.append(current)
    assert got == sorted((e, a, b, b - a + 1) for e, a, b in want)


@pytest.mark.parametrize("hot", ("10", "100000"))
@pytest.mark.parametrize("interpolate", (True, False))
def test_quantiles_of_large_and_small_groups(spark, table, hot, interpolate):
    spark.conf.set(HOT_ROWS_CONF, hot)
    try:
        probs = {"q1": 0.01, "q50": 0.5, "q95": 0.95} if interpolate else {"q50": 0.5}
        out = {r.episode_index: r for r in exact_quantiles(table, KEYS, "v", probs, interpolate).collect()}
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    for e in {r.episode_index for r in table.collect()}:
        x = sorted(r.v for r in table.collect() if r.episode_index == e and r.v is not None)
        if not x:
            assert e not in out
            continue
        assert out[e]._n == len(x)
        for name, p in probs.items():
            want = np.percentile(x, 100 * p) if interpolate else x[(len(x) - 1) // 2]
            assert abs(out[e][name] - want) < 1e-12


def test_a_burst_is_cut_by_rows(spark, small_blocks):
    """A run whose captures all fall into one day lies in many blocks and keeps its order, gaps and repeats included."""
    from kinelake.operators import blocks as B
    from kinelake.operators import windows as W
    from kinelake.session import HOT_ROWS_CONF

    rows = [(r, 10**15 + (i * 7919 % 500) // 2, i) for r, n in ((1, 500), (2, 3), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "run_id long, captured_at_ns long, sequence long").repartition(4)
    spark.conf.set(HOT_ROWS_CONF, "20")
    try:
        held, block = B.bounded_blocks(df, ["run_id"], ["captured_at_ns", "sequence"], W.time_block("captured_at_ns"))
        sizes = [r["count"] for r in held.groupBy("run_id", block).count().collect()]
        assert len(sizes) > 30 and max(sizes) < 60
        placed = {(r.run_id, r.captured_at_ns, r.sequence): r.frame_index for r in W.placed_in_time(df, "frame_index").collect()}
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    for run in (1, 2, None):
        own = sorted(k for k in placed if k[0] == run) if run is not None else sorted((k for k in placed if k[0] is None), key=lambda k: k[1:])
        assert [placed[k] for k in own] == list(range(len(own)))
    assert len(placed) == len(rows)
    assert W.placed_in_time(df.limit(0), "frame_index").count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_short_groups_are_indexed_in_one_shuffle(spark):
    rows = spark.range(500).select((F.col("id") % 40).alias("g"), (F.col("id") * 7 % 500).alias("i"))
    assert B.short_groups(rows, ["g"])
    block = F.floor(F.col("i") / 16).cast("long")
    whole = B.dense_index(rows, ["g"], ["i"], block, "n", short=True)
    cut = B.dense_index(rows, ["g"], ["i"], block, "n")
    assert exchanges(whole) == 1
    assert sorted(whole.collect()) == sorted(cut.collect())
    near = {"before": lambda w: F.lag("i").over(w), "after": lambda w: F.lead("i").over(w)}
    beside = lambda short: B.with_neighbours(whole, 1, 1, near, ["g"], "n", short)
    assert exchanges(beside(True)) == 1
    assert sorted(beside(True).collect(), key=str) == sorted(beside(False).select(beside(True).columns).collect(), key=str)


def test_long_groups_are_not_short(spark, small_blocks):
    assert not B.short_groups(spark.range(9).select(F.lit(1).alias("g")), ["g"])
    assert B.short_groups(spark.range(8).select(F.lit(1).alias("g")), ["g"])
