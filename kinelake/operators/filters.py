"""Zero-lag trajectory filters on joint vectors, per episode and joint, endpoints kept exactly.

All run as grouped maps over blocks with a halo. Finite impulse response filters (moving average, Gaussian, Savitzky-Golay)
need a halo of their window. The smoothing spline and the One-Euro filter depend on the whole series; their halo is long enough
for the dependence on what lies beyond it to fall under double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.functions import vectors as V
from kinelake.operators.blocks import BLOCK, EPISODE, HOME, add_halo
from kinelake.schema import CHANNEL_COLUMN, CHANNELS
from kinelake.session import block_rows, stage

# --- fixed values -------------------------------------------------------------------------------------------------
METHODS = ("spline", "gaussian", "savgol", "moving_average", "one_euro", "none")
MIN_FRAMES = 3
MOVING_AVERAGE_PER_STRENGTH = 6
GAUSSIAN_SIGMA_PER_STRENGTH, GAUSSIAN_MIN_SIGMA, GAUSSIAN_REACH = 2.0, 0.5, 3
SAVGOL_PER_STRENGTH, SAVGOL_BASE, SAVGOL_ORDER = 10, 3, 3
SPLINE_MIN_FRAMES = 5
ONE_EURO_BETA, ONE_EURO_DERIVATIVE_CUTOFF, ONE_EURO_MIN_STRENGTH = 0.007, 1.0, 0.1
MIN_FPS = 1e-3
# ------------------------------------------------------------------------------------------------------------------

# A term that has shrunk by this many e-foldings is below the last digit of a double.
VANISHED = 40.0
# Factors kept per penalty, and cells that splines of several penalties are fitted to at once (16 MB).
FACTORS_KEPT, FIT_CELLS = 1 << 17, 1 << 21


def resolve_method(requested: str | None) -> str:
    """The filter that will run for a requested name; an unknown name runs the Gaussian."""
    name = (requested or "spline").lower()
    return name if name in METHODS else "gaussian"


def method_labels(episodes: DataFrame, requested: str | None) -> DataFrame:
    """Requested and effective method per episode; fewer than three frames are never filtered."""
    effective = F.when(F.col("frames") < MIN_FRAMES, "none").otherwise(resolve_method(requested))
    return episodes.withColumns(
        {"requested_method": F.lit((requested or "spline").lower()), "effective_method": effective}
    )


# --- weights ------------------------------------------------------------------------------------------------------


def odd(number: int) -> int:
    return number + 1 if number % 2 == 0 else number


def moving_average_weights(strength: float) -> list[float]:
    window = max(1, odd(round(MOVING_AVERAGE_PER_STRENGTH * strength) + 1))
    return [1.0 / window] * window


def gaussian_weights(strength: float) -> list[float]:
    sigma = max(GAUSSIAN_MIN_SIGMA, GAUSSIAN_SIGMA_PER_STRENGTH * strength)
    radius = max(1, round(GAUSSIAN_REACH * sigma))
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def savgol_window(strength: float) -> int:
    return max(SAVGOL_ORDER + 2, odd(round(SAVGOL_PER_STRENGTH * strength) + SAVGOL_BASE))


def polynomial_projection(window: int) -> np.ndarray:
    """Matrix that replaces ``window`` samples by their least-squares cubic."""
    basis = np.vander(np.linspace(-1.0, 1.0, window), SAVGOL_ORDER + 1)
    return basis @ np.linalg.pinv(basis)


def savgol_matrix(frames: int, window: int) -> np.ndarray:
    """The whole filter as a matrix, for an episode shorter than the requested window."""
    window = min(window, frames if frames % 2 else frames - 1)
    if window <= SAVGOL_ORDER:
        return np.eye(frames)
    half, fit = window // 2, polynomial_projection(window)
    out = np.zeros((frames, frames))
    for i in range(frames):
        start = min(max(0, i - half), frames - window)
        out[i, start : start + window] = fit[i - start]
    return out


# --- block convolutions -------------------------------------------------------------------------------------------


def convolved(values: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """Weighted neighbour sum of each column (symmetric weights) with the first and last row repeated beyond the ends."""
    reach = len(weights) // 2
    padded = np.concatenate([values[:1].repeat(reach, axis=0), values, values[-1:].repeat(reach, axis=0)])
    return np.stack([np.convolve(padded[:, j], weights, "valid") for j in range(values.shape[1])], axis=1)


def savgol_fit(values: np.ndarray, size: int) -> np.ndarray:
    """Local cubic fit; within half a window of an end, the cubic of the outermost full window is followed."""
    n, half = len(values), size // 2
    if n < size:
        return savgol_matrix(n, size) @ values
    fit = polynomial_projection(size)
    middle = np.stack([np.convolve(values[:, j], fit[half][::-1], "valid") for j in range(values.shape[1])], axis=1)
    return np.concatenate([fit[:half] @ values[:size], middle, fit[half + 1 :] @ values[-size:]])


def _fir(frames: DataFrame, columns: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Weighted neighbour sum per block with a halo of the window's reach."""
    reach = len(weights) // 2
    if reach == 0:
        return frames.withColumns({c: V.widen(F.col(c)) for c in columns})
    return _grouped(frames, columns, reach, reach, lambda v, _: convolved(v, weights), 30.0, max(block_rows(frames.sparkSession), SERIES_ROWS))


def _savgol(frames: DataFrame, columns: Sequence[str], size: int) -> DataFrame:
    """A block sees a whole window beyond each of its edges, so only true ends of an episode are treated as ends."""
    return _grouped(frames, columns, size - 1, size - 1, lambda v, _: savgol_fit(v, size), 30.0, max(block_rows(frames.sparkSession), SERIES_ROWS))


# --- grouped maps -------------------------------------------------------------------------------------------------


def spline_halo(lam: float) -> int:
    """Frames after which a smoothing spline no longer depends on what lies beyond.

    Its kernel falls by one e-folding per sqrt(2) * lambda^(1/4) frames; below lambda = 1 the discrete system falls at
    least as fast as it does there.
    """
    return math.ceil(VANISHED * math.sqrt(2.0) * max(1.0, lam) ** 0.25)


_FACTORS: dict[float, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _factor(m: int, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Banded factors (diagonal, first and second subdiagonal) of R + lam Q'Q at unit knots.

    A longer system begins with the factors of a shorter one, so the longest of each penalty so far serves all.
    """
    known = _FACTORS.get(lam)
    if known is None or len(known[0]) < m:
        if m > FACTORS_KEPT:
            return _factored(m, lam)
        known = _factored(min(FACTORS_KEPT, max(2 * m, 256)), lam)
        _FACTORS[lam] = known
    d, l1, l2 = known
    return d[:m], l1[:m], l2[:m]


def _factored(m: int, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    diag, one, two = 2.0 / 3.0 + 6.0 * lam, 1.0 / 6.0 - 4.0 * lam, lam
    d, l1, l2 = np.empty(m), np.zeros(m), np.zeros(m)
    for i in range(m):
        if i >= 2:
            l2[i] = two / d[i - 2]
        if i >= 1:
            l1[i] = (one - (l2[i] * l1[i - 1] * d[i - 2] if i >= 2 else 0.0)) / d[i - 1]
        d[i] = diag - (l1[i] ** 2 * d[i - 1] if i >= 1 else 0.0) - (l2[i] ** 2 * d[i - 2] if i >= 2 else 0.0)
    return d, l1, l2


def smoothing_spline(values: np.ndarray, lam: float | Sequence[float]) -> np.ndarray:
    """Natural cubic smoothing spline at unit knots, column-wise: minimises squared error + lam * integral of g''^2.

    Second derivatives solve the banded system (R + lam Q'Q) c = Q'y; the fit is y - lam Q c. A penalty for each column may be given.
    """
    n = len(values)
    if n < SPLINE_MIN_FRAMES:
        return values.copy()
    m = n - 2
    if isinstance(lam, (int, float)):
        d, l1, l2 = (f[:, None] for f in _factor(m, lam))
    else:
        each = {x: _factor(m, float(x)) for x in set(lam)}
        d, l1, l2 = (np.stack([each[x][i] for x in lam], axis=1) for i in range(3))
        lam = np.asarray(lam, float)
    c = values[2:] - 2.0 * values[1:-1] + values[:-2]
    for i in range(1, m):
        c[i] -= l1[i] * c[i - 1]
        if i >= 2:
            c[i] -= l2[i] * c[i - 2]
    c /= d
    for i in range(m - 2, -1, -1):
        c[i] -= l1[i + 1] * c[i + 1]
        if i + 2 < m:
            c[i] -= l2[i + 2] * c[i + 2]
    out = values.copy()
    out[:-2] -= lam * c
    out[1:-1] += 2.0 * lam * c
    out[2:] -= lam * c
    return out


def lost_freedom(n: int, lam: float) -> float:
    """Trace of (identity - smoother), from the central bands of the inverse of the banded system."""
    m = n - 2
    d, l1, l2 = _factor(m, lam)
    b0, b1, b2 = np.zeros(m + 2), np.zeros(m + 2), np.zeros(m + 2)
    for i in range(m - 1, -1, -1):
        f1 = l1[i + 1] if i + 1 < m else 0.0
        f2 = l2[i + 2] if i + 2 < m else 0.0
        b1[i] = -f1 * b0[i + 1] - f2 * b1[i + 1]
        b2[i] = -f1 * b1[i + 1] - f2 * b0[i + 2]
        b0[i] = 1.0 / d[i] - f1 * b1[i] - f2 * b2[i]
    return lam * (6.0 * b0.sum() - 8.0 * b1[: m - 1].sum() + 2.0 * b2[: max(0, m - 2)].sum())


def freedom_of(n: int, lam: float) -> float:
    """``lost_freedom``, for long series continued in proportion: beyond the reach of both ends each frame adds the same."""
    base = 4 * spline_halo(lam)
    if n <= base + 1:
        return lost_freedom(n, lam)
    at = lost_freedom(base, lam)
    return at + (n - base) * (lost_freedom(base + 1, lam) - at)


def penalty_grid(longest: int) -> list[float]:
    """Penalties that cross-validation compares: powers of two up to the number of frames."""
    return [2.0**power for power in range(-20, max(1, int(longest)).bit_length())]


def one_euro_alpha(cutoff, dt: float):
    tau = 1.0 / (2.0 * math.pi * np.maximum(1e-6, cutoff))
    return 1.0 / (1.0 + tau / dt)


def one_euro_halo(strength: float, fps: float) -> int:
    """Warm-up frames after which the recursion has forgotten its start, at its slowest cutoff."""
    dt = 1.0 / max(MIN_FPS, fps)
    slow = min(ONE_EURO_DERIVATIVE_CUTOFF, 1.0 / max(ONE_EURO_MIN_STRENGTH, strength))
    return math.ceil(VANISHED / -math.log1p(-float(one_euro_alpha(slow, dt))))


def one_euro(values: np.ndarray, strength: float, fps: float) -> np.ndarray:
    """Adaptive low-pass; the derivative is taken against the previous filtered value."""
    dt = 1.0 / max(MIN_FPS, fps)
    slow = 1.0 / max(ONE_EURO_MIN_STRENGTH, strength)
    gain = one_euro_alpha(ONE_EURO_DERIVATIVE_CUTOFF, dt)
    out = values.copy()
    speed = np.zeros(values.shape[1])
    for t in range(1, len(values)):
        speed = gain * (values[t] - out[t - 1]) / dt + (1.0 - gain) * speed
        blend = one_euro_alpha(slow + ONE_EURO_BETA * np.abs(speed), dt)
        out[t] = blend * values[t] + (1.0 - blend) * out[t - 1]
    return out


def _ragged(lists: pa.ListArray, fit: Callable[[np.ndarray], np.ndarray], first: bool, last: bool) -> pa.ListArray:
    """Smooth vectors of different widths: a joint is null where a vector that its window needs lacks it. The ends of an episode
    stay as they are, and so does a missing vector."""
    rows = lists.to_pylist()
    width = max(len(r) for r in rows if r is not None)
    raw = np.array([[r[j] if r is not None and j < len(r) and r[j] is not None else np.nan for j in range(width)] for r in rows], float)
    absent = np.array([[r is None or j >= len(r) or r[j] is None for j in range(width)] for r in rows])
    smooth = fit(np.where(absent, 0.0, raw))
    lost = np.isnan(fit(np.where(absent, np.nan, 0.0)))
    out = []
    for i, r in enumerate(rows):
        whole = (first and i == 0) or (last and i == len(rows) - 1)
        out.append(r if r is None or whole else [None if lost[i, j] else float(smooth[i, j]) for j in range(len(r))])
    return pa.array(out, pa.list_(pa.float64()))


def _vectors(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))


def _grouped(
    frames: DataFrame, columns: Sequence[str], before: int, after: int, fit: Callable[[np.ndarray, float], np.ndarray],
    fps: float | str, rows: int, settings: dict[str, str] | None = None,
) -> DataFrame:
    """Apply a whole-series function to every block with its halo; columns other than the vectors are untouched.

    ``fit`` gets the values and the frame rate, or the vector's entry of ``settings``: a map column from joint to number.
    """
    rate = F.col(fps) if isinstance(fps, str) else F.lit(float(fps))
    keyed = frames.withColumn("_fps", rate.cast("double"))
    haloed = add_halo(keyed, before, max(1, after), rows=rows)
    typed = haloed.withColumns({c: V.widen(F.col(c)) for c in columns})
    extra = set((settings or {}).values())
    out_schema = T.StructType([f for f in typed.schema.fields if f.name not in {HOME, BLOCK, "_fps"} | extra])
    names = out_schema.names

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("frame_index")
        home = np.asarray(table.column(HOME).to_numpy(zero_copy_only=False), dtype=bool)
        index = table.column("frame_index").to_numpy()
        rate_value = table.column("_fps")[0].as_py()
        last_is_end = not (len(home) and not home[-1])
        new, raws, lams = {}, {}, []
        for c in columns:
            lists = table.column(c).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            width = len(flat) // len(lists) if len(lists) else 0
            if width == 0 or len(lists) < MIN_FRAMES:
                new[c] = lists
                continue
            sizes = pc.list_value_length(lists)
            if not settings and (sizes.null_count or pc.min(sizes).as_py() != width or pc.max(sizes).as_py() != width):
                new[c] = _ragged(lists, lambda v: fit(v, rate_value), index[0] == 0, last_is_end)
                continue
            raw = flat.reshape(len(lists), width).astype(float)
            if settings:
                known = dict(table.column(settings[c])[0].as_py() or [])
                if len(known) != width:
                    new[c] = _vectors(raw)
                    continue
                lams += [known[j] for j in range(width)]
            raws[c] = raw
        if raws:
            # The joints of all channels are columns of one fit.
            raw = np.concatenate(list(raws.values()), axis=1)
            smooth = fit(raw, lams if settings else rate_value)
            if index[0] == 0:
                smooth[0] = raw[0]
            if last_is_end:
                smooth[-1] = raw[-1]
            edges = np.cumsum([r.shape[1] for r in raws.values()])[:-1]
            new.update({c: _vectors(part) for c, part in zip(raws, np.split(smooth, edges, axis=1))})
        kept = pa.table([new[n] if n in new else table.column(n) for n in names], names=names)
        return kept.filter(pa.array(home))

    # A block without home rows (a halo behind the last one) yields nothing.
    return typed.groupBy(*EPISODE, BLOCK).applyInArrow(run, out_schema)


# --- the filters --------------------------------------------------------------------------------------------------


def _columns(channels: Sequence[str]) -> list[str]:
    return [CHANNEL_COLUMN[c] for c in channels]


def passthrough(frames: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    return frames.withColumns({c: V.widen(F.col(c)) for c in _columns(channels)})


def moving_average(frames: DataFrame, strength: float = 1.0, channels: Sequence[str] = CHANNELS) -> DataFrame:
    return _fir(frames, _columns(channels), moving_average_weights(max(0.0, strength)))


def gaussian(frames: DataFrame, strength: float = 1.0, channels: Sequence[str] = CHANNELS) -> DataFrame:
    return _fir(frames, _columns(channels), gaussian_weights(max(0.0, strength)))


def savgol(frames: DataFrame, strength: float = 1.0, channels: Sequence[str] = CHANNELS) -> DataFrame:
    return _savgol(frames, _columns(channels), savgol_window(max(0.0, strength)))


# Blocks of the whole-series filters: long, so that ordinary episodes are never cut at all.
SERIES_ROWS = 65_536


def spline(frames: DataFrame, strength: float = 1.0, channels: Sequence[str] = CHANNELS, rows: int | None = None) -> DataFrame:
    """Cubic smoothing spline with the strength as its penalty; 0 picks the penalty of each joint by cross-validation.

    Cross-validation scores whole episodes: every block, with its full halo, adds its squared residuals for each penalty, and
    the least generalised score of an episode's joint decides. Block sizes do not show in the result.
    """
    size = rows or max(block_rows(frames.sparkSession), SERIES_ROWS)
    columns = _columns(channels)
    if strength > 0:
        halo = spline_halo(strength)
        return _grouped(frames, columns, halo, halo, lambda v, _: smoothing_spline(v, strength), 30.0, size)
    lengths = stage(frames.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("_n")))
    grid = penalty_grid(lengths.agg(F.max("_n")).first()[0] or 1)
    halo = spline_halo(grid[-1])
    chosen = stage(_least_scores(_residuals(frames, columns, halo, size, grid), lengths, grid))
    penalties = chosen.groupBy(*EPISODE).agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col("column") == c, F.struct("joint", "lam")))).alias(f"_lam_{c}") for c in columns]
    )
    with_penalties = frames.join(penalties, list(EPISODE), "left")

    def fit(values: np.ndarray, lams: list[float]) -> np.ndarray:
        return smoothing_spline(values, lams)

    return _grouped(with_penalties, columns, halo, halo, fit, 30.0, size, {c: f"_lam_{c}" for c in columns})


def _residuals(frames: DataFrame, columns: Sequence[str], halo: int, size: int, grid: list[float]) -> DataFrame:
    """Squared residuals of each joint and penalty, added up over the frames of a block."""
    haloed = add_halo(frames.select(*EPISODE, "frame_index", *[V.widen(F.col(c)).alias(c) for c in columns]), halo, halo, rows=size)
    keys = frames.select(*EPISODE).schema.fields
    schema = T.StructType([
        *keys, T.StructField("column", T.StringType()), T.StructField("joint", T.IntegerType()),
        T.StructField("power", T.IntegerType()), T.StructField("sse", T.DoubleType()),
    ])

    def measure(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("frame_index")
        home = np.asarray(table.column(HOME).to_numpy(zero_copy_only=False), dtype=bool)
        out, raws = [], {}
        for c in columns:
            lists = table.column(c).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            width = len(flat) // len(lists) if len(lists) else 0
            if not width or len(lists) < SPLINE_MIN_FRAMES or not home.any():
                continue
            raws[c] = flat.reshape(len(lists), width).astype(float)
        if raws:
            raw = np.concatenate(list(raws.values()), axis=1)
            names = [(c, j) for c, r in raws.items() for j in range(r.shape[1])]
            # As many penalties at once as keep the copies small.
            some = max(1, FIT_CELLS // raw.size)
            for at in range(0, len(grid), some):
                lams = [lam for lam in grid[at : at + some] for _ in names]
                copies = np.tile(raw, len(lams) // len(names))
                left = ((copies - smoothing_spline(copies, lams)) ** 2)[home].sum(axis=0)
                out += [(*names[j % len(names)], at + j // len(names), float(x)) for j, x in enumerate(left)]
        key = [table.column(k)[0].as_py() if len(table) else None for k in EPISODE]
        rows = [(*key, *x) for x in out]
        return pa.table(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate([table.schema.field(k).type for k in EPISODE] + [pa.string(), pa.int32(), pa.int32(), pa.float64()])],
            names=[*EPISODE, "column", "joint", "power", "sse"],
        )

    found = haloed.groupBy(*EPISODE, BLOCK).applyInArrow(measure, schema)
    return found.groupBy(*EPISODE, "column", "joint", "power").agg(F.sum("sse").alias("sse"))


def _least_scores(residuals: DataFrame, lengths: DataFrame, grid: list[float]) -> DataFrame:
    """The penalty of the least generalised cross-validation score for each joint of an episode."""

    @F.pandas_udf("double")
    def freedom(n: pd.Series, power: pd.Series) -> pd.Series:
        known = {key: freedom_of(int(key[0]), grid[int(key[1])]) for key in set(zip(n, power))}
        return pd.Series([known[key] for key in zip(n, power)], dtype=float)

    # A penalty above an episode's length is outside its range.
    allowed = F.lit(grid[0]) * F.pow(F.lit(2.0), F.col("power")) <= F.col("_n")
    powers = F.explode(F.array(*[F.lit(i) for i in range(len(grid))])).alias("power")
    lost = lengths.select("_n").distinct().select("_n", powers).withColumn("_lost", freedom("_n", "power"))
    score = F.col("_n") * F.col("sse") / F.greatest(F.col("_lost") * F.col("_lost"), F.lit(1e-300))
    return (
        residuals.join(lengths, list(EPISODE)).where(allowed).join(lost, ["_n", "power"])
        .groupBy(*EPISODE, "column", "joint").agg(F.min(F.struct(score.alias("score"), "power")).alias("_best"))
        .withColumn("lam", F.lit(grid[0]) * F.pow(F.lit(2.0), F.col("_best.power"))).drop("_best")
    )


def one_euro_filter(
    frames: DataFrame, strength: float = 1.0, fps: float | str = 30.0, channels: Sequence[str] = CHANNELS,
    rows: int | None = None,
) -> DataFrame:
    """Causal One-Euro filter. ``fps`` is a number or the name of a column."""
    # The recursion forgets per second, not per frame: the highest rate needs the longest warm-up.
    fastest = frames.agg(F.max(F.col(fps).cast("double"))).first()[0] or MIN_FPS if isinstance(fps, str) else float(fps)
    halo = one_euro_halo(strength, fastest)
    size = rows or max(block_rows(frames.sparkSession), SERIES_ROWS)
    return _grouped(frames, _columns(channels), halo, 0, lambda v, rate: one_euro(v, strength, rate), fps, size)


def smooth(
    frames: DataFrame, method: str | None = "spline", strength: float = 1.0, fps: float | str = 30.0,
    channels: Sequence[str] = CHANNELS,
) -> DataFrame:
    """Smooth the channels of every episode; adds ``smoothing_method`` and ``smoothing_strength``."""
    name, strength = resolve_method(method), max(0.0, float(strength))
    if name == "none":
        out = passthrough(frames, channels)
    elif name == "spline":
        out = spline(frames, strength, channels)
    elif name == "savgol":
        out = savgol(frames, strength, channels)
    elif name == "moving_average":
        out = moving_average(frames, strength, channels)
    elif name == "one_euro":
        out = one_euro_filter(frames, strength, fps, channels)
    else:
        out = gaussian(frames, strength, channels)
    return out.withColumns({"smoothing_method": F.lit(name), "smoothing_strength": F.lit(strength)})
