"""Path and repair operators on inputs with known answers."""

import math

from pyspark.sql import functions as F

from kinelake.operators import aggregates as A
from kinelake.operators import paths as G


def points(spark, xyz):
    rows = [("d", 0, i, *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "dataset_id string, episode_index bigint, frame_index bigint, x double, y double, z double")


def kept(df):
    return [(r.x, r.y, r.z) for r in df.orderBy("frame_index").collect()]


def test_isolated_spike_goes_sustained_move_stays(spark):
    walk = [(i, 0, 0) for i in range(8)]
    spiked = walk[:4] + [(1000, 1000, 0)] + walk[4:]
    assert kept(G.reject_spikes(points(spark, spiked))) == [tuple(map(float, p)) for p in walk]
    moved = [(i, 0, 0) for i in (0, 1, 2, 100, 101, 102)]
    assert len(kept(G.reject_spikes(points(spark, moved)))) == 6


def test_spikes_in_a_row_follow_the_last_kept_point(spark, small_blocks):
    import random

    random.seed(3)
    xyz = [(i + (500 * random.random() if random.random() < 0.2 else 0), 0.0, 0.0) for i in range(120)]

    def dist(a, b):
        return math.dist(a, b)

    steps = sorted(dist(a, b) for a, b in zip(xyz, xyz[1:]))
    mid = steps[(len(steps) - 1) // 2]
    mad = sorted(abs(s - mid) for s in steps)[(len(steps) - 1) // 2]
    limit = max(8 * mid, mid + 8 * mad, 1e-4)
    expected = [xyz[0]]
    for p, nxt in zip(xyz[1:], xyz[2:]):
        if not (dist(expected[-1], p) > limit and dist(p, nxt) > limit and dist(expected[-1], nxt) <= 2 * limit):
            expected.append(p)
    expected.append(xyz[-1])
    assert kept(G.reject_spikes(points(spark, xyz))) == [tuple(map(float, p)) for p in expected]


def brute_spikes(xyz):
    steps = sorted(math.dist(a, b) for a, b in zip(xyz, xyz[1:]))
    mid = steps[(len(steps) - 1) // 2]
    mad = sorted(abs(s - mid) for s in steps)[(len(steps) - 1) // 2]
    limit = max(8 * mid, mid + 8 * mad, 1e-4)
    expected = [xyz[0]]
    for p, nxt in zip(xyz[1:], xyz[2:]):
        if not (math.dist(expected[-1], p) > limit and math.dist(p, nxt) > limit and math.dist(expected[-1], nxt) <= 2 * limit):
            expected.append(p)
    return [*expected, xyz[-1]]


def test_one_run_of_jumps_over_many_blocks(spark, small_blocks):
    import random

    random.seed(5)
    walk = [(float(i), 0.0, 0.0) for i in range(130)]
    # Around the last point of the walk: no point of the ring is ever kept, so what is kept passes through every block.
    ring = [(129 + 12 * math.cos(a), 12 * math.sin(a), 0.0) for a in (i * 2.5 for i in range(60))]
    wild = [(random.uniform(-40, 40), random.uniform(-40, 40), random.uniform(-9, 9)) for _ in range(50)]
    for xyz in (walk + ring, walk + ring + wild, walk + wild + ring + walk[:20]):
        found, wanted = kept(G.reject_spikes(points(spark, xyz))), brute_spikes(xyz)
        assert found == wanted
    assert len(brute_spikes(walk + ring)) < len(walk) + 5


def test_gap_splits_path(spark):
    rows = G.split_path(points(spark, [(x, 0, 0) for x in (0, 1, 2, 100, 101, 102)])).collect()
    assert {r.piece for r in rows} == {0, 1} and all(r.threshold < 98 for r in rows)
    assert sum(r.cut for r in rows) == 1


def test_short_fragments_are_marked(spark):
    xyz = [(i * 0.1, 0, 0) for i in range(5)] + [(1000 + i * 0.1, 0, 0) for i in range(100)]
    totals = spark.createDataFrame([("d", 0, 105)], "dataset_id string, episode_index bigint, total bigint")
    marked = G.keep_segments(G.split_path(points(spark, xyz)), totals)
    assert marked.where("kept").count() == 100 and marked.first().minimum_points == 8
    still = G.clean_path(points(spark, [(0, 0, 0)] * 6)).first()
    assert still.outcome == "stationary" and still.segments == 0


def test_bounds_tolerance(spark):
    def held(inner):
        outer = {f"{e}_{a}": F.lit(v) for e, v in (("min", 10.0), ("max", 20.0)) for a in "xyz"}
        box = {f"{e}_{a}": F.lit(v) for e, v in zip(("min", "max"), inner) for a in "xyz"}
        return spark.range(1).select(A.bounds_include(outer, box).alias("v")).first().v

    assert held((10.0, 20.0005)) and not held((0.0, 20.0)) and not held((100.0, 200.0))


def test_sanitize_repairs_the_bad_row(spark):
    series = {0: [0.0, 1.0, 1000.0, 2.0, 3.0], 1: [10.0, 11.0, float("nan"), 13.0, 14.0], 2: [float("nan")] * 5}
    rows = [("d", 0, "action", j, i, v) for j, col in series.items() for i, v in enumerate(col)]
    values = spark.createDataFrame(
        rows, "dataset_id string, episode_index bigint, channel string, joint int, frame_index bigint, value double"
    )
    out = {(r.joint, r.frame_index): r for r in G.sanitize(values).collect()}
    assert out[0, 2].value == 1.5 and out[1, 2].value == 12.0
    assert sum(r.repaired for k, r in out.items() if k[0] < 2) == 2
    assert all(out[2, i].value == 0.0 and out[2, i].repaired for i in range(5))
    assert out[0, 0].value == 0.0 and out[0, 4].value == 3.0


def test_repairs_do_not_depend_on_the_size_of_a_series(spark):
    """Series in one task and block by block: gaps, spikes, strays, ends, missing throughout, short and constant ones."""
    import random

    from kinelake.session import HOT_ROWS_CONF

    random.seed(9)
    rows = []
    for e in range(8):
        for t in range(3 + e * 12):
            value = math.sin(t / 5) + random.gauss(0, 0.01)
            roll = random.random()
            value = None if roll < 0.1 else math.nan if roll < 0.15 else math.inf if roll < 0.18 else value + 40 if roll < 0.25 else value
            rows.append(("d", e, "action", 0, t, None if e == 3 else 1.5 if e == 4 else value, "kept"))
    rows.append(("d", 9, "action", 0, 0, 2.0, "kept"))
    df = spark.createDataFrame(rows, "dataset_id string, episode_index bigint, channel string, joint int, frame_index bigint, value double, extra string").repartition(3)
    take = lambda out: {(r.episode_index, r.frame_index): (r.value, r.repaired, r.extra) for r in out.collect()}
    keys = ["dataset_id", "episode_index", "channel", "joint"]
    series, blocks = take(G._sanitize_series(df, keys)), take(G._sanitize_blocks(df, keys))
    spark.conf.set(HOT_ROWS_CONF, "30")
    try:
        mixed = take(G.sanitize(df))
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert series.keys() == blocks.keys() == mixed.keys() and len(series) == len(rows)
    for k, (value, repaired, extra) in blocks.items():
        for other in (series[k], mixed[k]):
            assert other[1:] == (repaired, extra) and abs(other[0] - value) < 1e-12
    assert sum(r[1] for r in series.values()) > 40 and series[3, 5][0] == 0.0 and series[4, 5] == (1.5, False, "kept")
