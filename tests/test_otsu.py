"""Splits of many series at once."""

import numpy as np
from pyspark.sql import functions as F

from kinelake.operators import analysis as N


def test_many_series_split_like_each_alone():
    rng = np.random.default_rng(3)
    series = [rng.choice([0.0, 0.05, 0.9], n) + np.round(rng.normal(0, 0.1, n), 3) * (i % 3) for i, n in enumerate(rng.integers(0, 90, 400))]
    series += [np.full(6, 0.5), np.array([1.0, np.nan, 2.0, 3.0, 4.0]), np.array([1.0, np.inf, 2.0, 3.0, -np.inf]), np.array([1e12, 1e12 + 1, 3e12, 5.0])]
    rows = np.array([len(s) + (i % 5 == 0) for i, s in enumerate(series)])
    of = np.repeat(np.arange(len(series)), [len(s) for s in series])
    mixed = rng.permutation(len(of))
    with np.errstate(invalid="ignore"):
        best, threshold = N.splits_of(np.concatenate(series)[mixed], of[mixed], rows)
        alone = [N.split_of(s, int(n)) for s, n in zip(series, rows)]
    np.testing.assert_allclose(best, [a for a, _ in alone], rtol=0, atol=2e-12)
    np.testing.assert_allclose(threshold, [t for _, t in alone], rtol=1e-12)


def test_rounding_of_many_numbers():
    values = np.array([0.0, 0.5e-9, 1.5e-9, 0.1234567895, -0.1234567895, -2.5e-9, 1e20, np.nan, np.inf, 123456.7890123455, 0.9999999995])
    np.testing.assert_array_equal(N.half_up_all(values, 9), [N.half_up(float(v), 9) for v in values])


def test_tiny_episodes_share_calls(spark, monkeypatch):
    """Episodes that batches cut, null keys among them."""
    frames = spark.range(3000).select(
        F.when(F.col("id") % 7 != 0, "d").alias("dataset_id"), F.floor(F.col("id") / 3).alias("episode_index"), (F.col("id") % 3).alias("frame_index"),
        F.array((F.col("id") % 5).cast("double"), F.when(F.col("id") % 4 != 0, F.lit(1.0))).alias("observation_state"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.dataset_id, r.episode_index, r.joint): (r.separation, r.threshold, r.n) for r in N._otsu_series(frames).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for r in frames.collect():
        for j, v in enumerate(r.observation_state):
            want.setdefault((r.dataset_id, r.episode_index, j), []).append(v)
    assert set(got) == set(want)
    for key, values in want.items():
        s, t = N.split_of(np.array([v for v in values if v is not None], float), len(values))
        np.testing.assert_allclose(got[key], (s, t, len(values)), rtol=1e-12)
