"""Filters: endpoints, length, jerk, and equality with plain array computations, whatever the block size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import filters as S
from kinelake.operators.aggregates import jerk_reduction

CHANNELS = ("action",)


def frames(spark, values, episode=0):
    rows = [("d", episode, i, [float(x) for x in row]) for i, row in enumerate(values)]
    return spark.createDataFrame(rows, "dataset_id string, episode_index bigint, frame_index bigint, action array<double>")


def noisy(n=120):
    rng = np.random.default_rng(7)
    t = np.arange(n) / 60.0
    return np.stack([np.sin(3 * t) + rng.normal(0, 0.05, n), np.cos(2 * t) + rng.normal(0, 0.05, n)], axis=1)


def result(df):
    return np.array([r.action for r in df.orderBy("frame_index").collect()])


def brute(method, y):
    n = len(y)
    if method in ("gaussian", "moving_average"):
        w = np.array((S.gaussian_weights if method == "gaussian" else S.moving_average_weights)(1.0))
        r = len(w) // 2
        out = np.array([sum(w[k + r] * y[min(max(i + k, 0), n - 1)] for k in range(-r, r + 1)) for i in range(n)])
    elif method == "savgol":
        out = np.einsum('ij,jk->ik', S.savgol_matrix(n, S.savgol_window(1.0)), y)
    elif method == "one_euro":
        out = S.one_euro(y, 1.0, 60.0)
    else:
        out = S.smoothing_spline(y, 1.0)
    out[0], out[-1] = y[0], y[-1]
    return out


ALL = ("spline", "gaussian", "savgol", "moving_average", "one_euro")


@pytest.mark.parametrize("method", ALL)
def test_equals_array_computation_and_calms(spark, method):
    y = noisy()
    raw = frames(spark, y)
    smooth = S.smooth(raw, method, 1.0, 60.0, CHANNELS)
    got = result(smooth)
    assert got.shape == y.shape
    assert np.array_equal(got[[0, -1]], y[[0, -1]])
    assert np.allclose(got, brute(method, y), atol=1e-9)
    assert jerk_reduction(raw, smooth, "action").first().jerk_reduction_pct > 10


@pytest.mark.parametrize("method", ("gaussian", "savgol", "moving_average"))
def test_blocks_do_not_show(spark, small_blocks, method):
    y = noisy(61)
    assert np.allclose(result(S.smooth(frames(spark, y), method, 1.0, 60.0, CHANNELS)), brute(method, y), atol=1e-12)


def test_series_filters_forget_what_is_beyond_the_halo(spark):
    y = noisy(900)
    got = result(S.spline(frames(spark, y), 1.0, CHANNELS, rows=128))
    assert np.allclose(got, brute("spline", y), atol=1e-12)
    got = result(S.one_euro_filter(frames(spark, y), 1.0, 60.0, CHANNELS, rows=450))
    assert np.allclose(got, brute("one_euro", y), atol=1e-12)


@pytest.mark.parametrize("method", ALL)
def test_short_episodes_keep_endpoints(spark, method):
    lengths = (1, 2, 3, 4, 5, 6, 12)
    raw = frames(spark, noisy(lengths[0]), lengths[0])
    for n in lengths[1:]:
        raw = raw.union(frames(spark, noisy(n), n))
    smooth = S.smooth(raw.coalesce(1), method, 1.0, 30.0, CHANNELS).toPandas().sort_values("frame_index")
    for n in lengths:
        y, got = noisy(n), np.array(smooth[smooth.episode_index == n].action.tolist())
        assert got.shape == y.shape and np.array_equal(got[[0, -1]], y[[0, -1]])
        if method == "savgol" and n >= 3:
            assert np.allclose(got, brute(method, y))


@pytest.mark.parametrize("lam", (0.3, 1.0, 20.0))
def test_spline_meets_its_optimality_condition(lam):
    y = noisy(40)
    g = S.smoothing_spline(y, lam)
    c = np.zeros((38, 2))
    for i in range(38):
        c[i] = (y[i] - g[i]) / lam + (2 * c[i - 1] if i >= 1 else 0) - (c[i - 2] if i >= 2 else 0)
    bent = g[2:] - 2 * g[1:-1] + g[:-2]
    padded = np.concatenate([np.zeros((1, 2)), c, np.zeros((1, 2))])
    assert np.allclose(bent, 2 / 3 * c + (padded[:-2] + padded[2:]) / 6, atol=1e-8)
    # The trace equals the sum of the smoother's losses on unit vectors.
    losses = sum(1 - S.smoothing_spline(np.eye(40)[:, [k]], lam)[k, 0] for k in range(40))
    assert abs(losses - S.lost_freedom(40, lam)) < 1e-9


def best_penalty(y):
    """Cross-validation over the whole series at once."""
    n = len(y)
    score = lambda lam: n * float(((y - S.smoothing_spline(y, lam)) ** 2).sum()) / S.lost_freedom(n, lam) ** 2
    return min((lam for lam in S.penalty_grid(n) if lam <= n), key=score)


def test_spline_keeps_straight_lines_and_picks_a_penalty(spark):
    line = np.stack([np.arange(40.0), 3 - 2 * np.arange(40.0)], axis=1)
    assert np.allclose(S.smoothing_spline(line, 5.0), line)
    y = noisy(300)
    expected = np.concatenate([S.smoothing_spline(y[:, [j]], best_penalty(y[:, [j]])) for j in range(y.shape[1])], axis=1)
    expected[[0, -1]] = y[[0, -1]]
    halo = S.spline_halo(S.penalty_grid(300)[-1])
    for rows in (None, halo):
        assert np.allclose(result(S.spline(frames(spark, y), 0.0, CHANNELS, rows)), expected, atol=1e-9)


def test_freedom_of_long_series():
    for lam in (0.01, 1.0, 30.0):
        n = 6 * S.spline_halo(lam)
        assert abs(S.freedom_of(n, lam) - S.lost_freedom(n, lam)) < 1e-7


def test_windows():
    assert len(S.moving_average_weights(1.0)) == 7 and len(S.gaussian_weights(1.0)) == 13 and S.savgol_window(1.0) == 13
    assert math.isclose(sum(S.gaussian_weights(0.3)), 1.0)
    assert S.resolve_method("none") == "none" and S.resolve_method("median") == "gaussian" and S.resolve_method(None) == "spline"


def test_spline_fits_each_column_with_its_own_penalty():
    values = np.random.default_rng(8).normal(size=(70, 6))
    lams = [0.5, 4.0, 0.5, 2.0**-20, 64.0, 1.0]
    together = S.smoothing_spline(values, lams)
    for j, lam in enumerate(lams):
        np.testing.assert_array_equal(together[:, j], S.smoothing_spline(values[:, [j]], lam)[:, 0])


def test_spline_factors_do_not_depend_on_the_lengths_before():
    for m in (5, 900, 40, 300):
        for found, alone in zip(S._factor(m, 3.0), S._factored(m, 3.0)):
            np.testing.assert_array_equal(found, alone)
