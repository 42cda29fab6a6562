"""Self-calibrating episode analysis: gripper discovery, motion, slips, stalls, segments, for all episodes at once."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.functions import vectors as V
from kinelake.operators.aggregates import long_form
from kinelake.operators.blocks import (
    EPISODE,
    exact_quantiles,
    frame_block,
    running_total,
    with_neighbours,
)
from kinelake.session import block_rows, hot_rows, stage

# --- fixed values -------------------------------------------------------------------------------------------------
OTSU_STEPS = 64
OTSU_LOW, OTSU_HIGH = 0.01, 0.99
OTSU_MIN_FRAMES = 4
MARGIN_FLOOR = 1e-9
MOVING_QUANTILE = 0.60
NOISE_QUANTILE, NOISE_FACTOR = 0.90, 2.0
STALL_QUANTILE = 0.95
SLIP_FRAMES = 3
MOVE_SHARE = 0.5
# Values are compared with data-derived limits after rounding, so that the last digit of an interpolation cannot decide.
DIGITS = 9
RATIO_DIGITS = 12
# ------------------------------------------------------------------------------------------------------------------


def nine(col: Column) -> Column:
    return F.round(col, DIGITS)


def otsu(frames: DataFrame) -> DataFrame:
    """Best two-cluster split of each joint: separation (between-class over total variance) and threshold.

    An ordinary episode is one series of vectors in one task: nothing is spread out into rows per joint. Episodes above
    ``hot_rows`` frames take the way over counted rows (``_otsu_counted``); both follow the same formulas, so the size does not show.
    """
    sizes = frames.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("_n"))
    most = hot_rows(frames.sparkSession)
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= most:
        return _otsu_series(frames)
    large = stage(sizes.where(F.col("_n") > most).select(*EPISODE))
    return _otsu_series(frames.join(large, list(EPISODE), "left_anti")).unionByName(_otsu_counted(frames.join(large, list(EPISODE))))


def half_up(value: float, digits: int) -> float:
    """As the engine rounds: on the shortest decimal form, halves away from zero."""
    if not math.isfinite(value) or abs(value) >= 2.0**52:
        return value
    return float(Decimal(repr(float(value))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def split_of(values: np.ndarray, rows: int) -> tuple[float, float]:
    """Separation and threshold of one joint's rounded values; ``rows`` counts missing ones too."""
    if not len(values):
        return 0.0, math.nan
    x = np.sort(values)

    def percentile(p: float) -> float:
        at = p * (len(x) - 1)
        low, high = math.floor(at), math.ceil(at)
        value = x[low] if low == high or x[low] == x[high] else (high - at) * x[low] + (at - low) * x[high]
        return half_up(value, DIGITS)

    low, high, mean, variance = percentile(OTSU_LOW), percentile(OTSU_HIGH), float(x.mean()), float(x.var())
    fallback = mean if rows < OTSU_MIN_FRAMES else (low + high) / 2
    if rows < OTSU_MIN_FRAMES or x[0] == x[-1] or not high > low:
        return 0.0, fallback
    limits = low + np.arange(OTSU_STEPS) * ((high - low) / float(OTSU_STEPS - 1))
    limits[-1] = high
    bucket = np.searchsorted(limits, x, "left")
    below, sums = np.cumsum(np.bincount(bucket, minlength=OTSU_STEPS + 1)), np.cumsum(np.bincount(bucket, x, OTSU_STEPS + 1))
    best, threshold = 0.0, fallback
    for k in np.unique(bucket):
        if k < OTSU_STEPS and below[k] < rows:
            share = below[k] / rows
            gap = sums[k] / below[k] - (rows * mean - sums[k]) / (rows - below[k])
            ratio = half_up(share * (1 - share) * gap * gap / variance, RATIO_DIGITS)
            if ratio > best:
                best, threshold = ratio, float(limits[k])
    return best, threshold


def half_up_all(values: np.ndarray, digits: int) -> np.ndarray:
    """``half_up`` of many numbers: scaled integers where these are clear of a tie, one by one where not."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = values * 10.0**digits
        down = np.floor(scaled)
        out = (down + (scaled - down >= 0.5)) / 10.0**digits
        clear = (np.abs(scaled) < 2.0**40) & (np.abs(scaled - down - 0.5) > 1e-3)
    for i in np.flatnonzero(~clear):
        out[i] = half_up(float(values[i]), digits)
    return out


def splits_of(values: np.ndarray, series: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``split_of`` of many series at once: ``series`` numbers the series of each value, ``rows`` has the length of each."""
    count = len(rows)
    best, threshold = np.zeros(count), np.full(count, math.nan)
    odd = np.unique(series[~np.isfinite(values)])
    for i in odd:
        best[i], threshold[i] = split_of(values[series == i], int(rows[i]))
    n = np.bincount(series, minlength=count)
    n[odd] = 0
    order = np.lexsort((values, series))
    order = order[n[series[order]] > 0]
    x, of = values[order], series[order]
    here = np.flatnonzero(n)
    if not len(here):
        return best, threshold
    start, size, total = np.zeros(count, int), np.maximum(n, 1), rows.astype(float)
    start[here] = np.cumsum(n[here]) - n[here]

    def percentile(p: float) -> np.ndarray:
        at = p * (size - 1)
        low, high = np.floor(at), np.ceil(at)
        a, b = x[start + low.astype(int)], x[start + high.astype(int)]
        return half_up_all(np.where(a == b, a, (high - at) * a + (at - low) * b), DIGITS)

    start[n == 0] = 0
    size[n == 0] = 1
    low, high = percentile(OTSU_LOW), percentile(OTSU_HIGH)
    mean = np.bincount(of, x, count) / size
    variance = np.bincount(of, (x - mean[of]) ** 2, count) / size
    threshold[here] = np.where(rows < OTSU_MIN_FRAMES, mean, (low + high) / 2)[here]
    usable = (n > 0) & (rows >= OTSU_MIN_FRAMES) & (x[start] != x[start + size - 1]) & (high > low)
    x, of = x[usable[of]], of[usable[of]]
    if not len(x):
        return best, threshold
    step = (high - low) / float(OTSU_STEPS - 1)

    def limit(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.where(k == OTSU_STEPS - 1, high[i], low[i] + k * step[i])

    # Rounding may put a value off its bucket; the comparison with the limits settles it.
    bucket = np.clip(np.ceil((x - low[of]) / step[of]), 0, OTSU_STEPS).astype(int)
    while (late := (bucket > 0) & (x <= limit(of, bucket - 1))).any():
        bucket -= late
    while (early := (bucket < OTSU_STEPS) & (x > limit(of, bucket))).any():
        bucket += early
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])])
    at, k, c = of[first], bucket[first], np.diff(np.r_[first, len(x)])
    sums, below = np.add.reduceat(x, first), c.copy()
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]], np.arange(len(at)), 0))
    for rank in range(1, int(place.max()) + 1):
        i = np.flatnonzero(place == rank)
        sums[i] += sums[i - 1]
        below[i] += below[i - 1]
    inner = (k < OTSU_STEPS) & (below < rows[at])
    at, k, sums, below = at[inner], k[inner], sums[inner], below[inner]
    share = below / total[at]
    gap = sums / below - (total[at] * mean[at] - sums) / (total[at] - below)
    ratio = half_up_all(share * (1 - share) * gap * gap / variance[at], RATIO_DIGITS)
    # The largest ratio of each series, at its lowest threshold.
    ranked = np.lexsort((k, -ratio, at))
    top = ranked[np.r_[True, at[ranked][1:] != at[ranked][:-1]]] if len(ranked) else ranked
    top = top[ratio[top] > 0]
    best[at[top]], threshold[at[top]] = ratio[top], limit(at[top], k[top])
    return best, threshold


def _otsu_series(frames: DataFrame) -> DataFrame:
    """Splits of whole episodes, as many at once as a batch of rows holds: most episodes are far too short for a call of their own."""
    keys = frames.select(*EPISODE).schema.fields
    kinds = T.StructType([
        *keys, T.StructField("joint", T.IntegerType()), T.StructField("separation", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()), T.StructField("n", T.LongType()),
    ])

    def starts_of(table: pa.Table) -> np.ndarray:
        """First row of each episode."""
        new = np.zeros(max(0, len(table) - 1), bool)
        for name in EPISODE:
            column = table.column(name)
            a, b = column.slice(1), column.slice(0, len(column) - 1)
            new |= np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(pc.is_null(a)) != np.asarray(pc.is_null(b)))
        return np.r_[0, np.flatnonzero(new) + 1]

    def split(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        vectors = pa.concat_arrays(table.column("v").chunks)
        sizes = np.nan_to_num(pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(float)).astype(int)
        flat, begins = vectors.flatten(), np.cumsum(sizes) - sizes
        values, known = flat.to_numpy(zero_copy_only=False).astype(float), np.asarray(flat.is_valid())
        episode = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(table)]))
        found = []
        for joint in range(int(sizes.max(initial=0))):
            has = sizes > joint
            rows = np.bincount(episode[has], minlength=len(starts))
            at, of = begins[has] + joint, episode[has]
            separation, threshold = splits_of(values[at][known[at]], of[known[at]], rows)
            e = np.flatnonzero(rows)
            found.append((e, np.full(len(e), joint), separation[e], threshold[e], rows[e]))
        e, *columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, int)] * 5
        key = [pa.concat_arrays(table.column(k).chunks).take(pa.array(starts[e])) for k in EPISODE]
        kind = (pa.int32(), pa.float64(), pa.float64(), pa.int64())
        return pa.record_batch([*key, *[pa.array(c, t) for c, t in zip(columns, kind)]], names=[*EPISODE, "joint", "separation", "threshold", "n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            starts = starts_of(table) if len(table) else np.zeros(0, int)
            # The last episode may go on in the next batch.
            if len(starts) > 1:
                yield split(table.slice(0, starts[-1]), starts[:-1])
                held = table.slice(starts[-1]).to_batches()
        table = pa.Table.from_batches(held) if held else None
        if table is not None and len(table):
            yield split(table, starts_of(table))

    rounded = F.transform(V.widen(F.col("observation_state")), nine)
    rows = frames.select(*EPISODE, rounded.alias("v"))
    return rows.repartition(*EPISODE).sortWithinPartitions(*EPISODE).mapInArrow(run, kinds)


def _otsu_counted(frames: DataFrame) -> DataFrame:
    """The splits of episodes of any length over rows that are counted by bucket.

    The 64 candidate thresholds are evenly spaced between the 1st and 99th percentile. Each value is counted into the
    first threshold at or above it; cumulative counts and sums over those at most 65 buckets give every split, so the
    frames are read once per pass whatever the number of thresholds.
    """
    keys = [*EPISODE, "joint"]
    values = stage(long_form(frames).select(*keys, nine(F.col("value")).alias("x")))
    ends = exact_quantiles(values, keys, "x", {"lo": OTSU_LOW, "hi": OTSU_HIGH})
    shape = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("mean"),
        F.var_pop("x").alias("variance"),
        (F.min("x") == F.max("x")).alias("flat"),
    )
    base = stage(
        shape.join(
            ends.select(*keys, nine(F.col("lo")).alias("lo"), nine(F.col("hi")).alias("hi")), keys
        )
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(float(OTSU_STEPS - 1))

    def threshold(k: Column) -> Column:
        return F.when(k == OTSU_STEPS - 1, F.col("hi")).otherwise(F.col("lo") + k * step)

    guess = F.ceil((F.col("x") - F.col("lo")) / step).cast("long")
    guess = F.greatest(F.lit(0), F.least(F.lit(OTSU_STEPS), guess))
    # Rounding may put a value one bucket off; the exact comparison settles it.
    bucket = (
        F.when((F.col("g") > 0) & (F.col("x") <= threshold(F.col("g") - 1)), F.col("g") - 1)
        .when((F.col("g") < OTSU_STEPS) & (F.col("x") > threshold(F.col("g"))), F.col("g") + 1)
        .otherwise(F.col("g"))
    )
    usable = (F.col("n") >= OTSU_MIN_FRAMES) & ~F.col("flat") & (F.col("hi") > F.col("lo"))
    counted = (
        values.join(base.where(usable), keys)
        .withColumn("g", guess)
        .withColumn("bucket", bucket)
        .groupBy(*keys, "bucket")
        .agg(F.count(F.lit(1)).alias("c"), F.sum("x").alias("s"))
    )
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = counted.select(
        *keys, "bucket", F.sum("c").over(upto).alias("below"), F.sum("s").over(upto).alias("below_sum")
    ).join(base, keys)
    share = F.col("below") / F.col("n")
    gap = F.col("below_sum") / F.col("below") - (F.col("n") * F.col("mean") - F.col("below_sum")) / (
        F.col("n") - F.col("below")
    )
    ratio = F.round(share * (1 - share) * gap * gap / F.col("variance"), RATIO_DIGITS)
    splits = cumulative.where((F.col("bucket") < OTSU_STEPS) & (F.col("below") < F.col("n"))).select(
        *keys, ratio.alias("ratio"), "bucket", threshold(F.col("bucket")).alias("at")
    )
    best = (
        splits.where(F.col("ratio") > 0)
        .groupBy(*keys)
        .agg(F.max(F.struct("ratio", -F.col("bucket"), "at")).alias("b"))
    )
    fallback = F.when(F.col("n") < OTSU_MIN_FRAMES, F.col("mean")).otherwise((F.col("lo") + F.col("hi")) / 2)
    return base.join(best, keys, "left").select(
        *keys,
        F.coalesce(F.col("b.ratio"), F.lit(0.0)).alias("separation"),
        F.coalesce(F.col("b.at"), fallback).alias("threshold"),
        "n",
    )


def ranked_joints(separations: DataFrame) -> DataFrame:
    """The two most bimodal joints of each episode; ties go to the lower joint."""
    order = Window.partitionBy(*EPISODE).orderBy(F.desc("separation"), "joint")
    return separations.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2)


def discover_gripper(separations: DataFrame) -> DataFrame:
    """The joint that behaves like a gripper, its threshold, and how sure that is."""
    top = ranked_joints(separations).groupBy(*EPISODE).agg(
        F.max(F.when(F.col("rank") == 1, F.col("joint"))).alias("gripper_index"),
        F.max(F.when(F.col("rank") == 1, F.col("threshold"))).alias("gripper_threshold"),
        F.max(F.when(F.col("rank") == 1, F.col("separation"))).alias("separation"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("separation"))), F.lit(0.0)).alias("runner_up"),
        F.max("n").alias("frames"),
    )
    margin = F.col("separation") - F.col("runner_up")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("separation"))) * (
        0.5 + 0.5 * F.least(F.lit(1.0), margin / (F.col("separation") + MARGIN_FLOOR))
    )
    return top.withColumn("gripper_confidence", sure)


@dataclass
class Signals:
    """Per-frame evidence and what it was judged by."""

    grippers: DataFrame  # one row per episode with joints
    cutoffs: DataFrame  # moving and stall limits per episode
    frames: DataFrame  # one row per frame of every episode with enough data


def gripper_frames(frames: DataFrame, grippers: DataFrame) -> DataFrame:
    """Binarised gripper state and command, arm vector, and gap between command and state, per frame."""
    g = F.col("gripper_index")
    limit = nine(F.col("gripper_threshold"))
    obs, act = V.widen(F.col("observation_state")), V.widen(F.col("action"))
    same = F.size("action") == F.size("observation_state")
    enough = grippers.where((F.col("frames") >= 2) & (F.col("gripper_index") >= 0))
    return frames.join(enough.select(*EPISODE, "gripper_index", "gripper_threshold"), list(EPISODE)).select(
        *EPISODE,
        "frame_index",
        V.without(obs, g).alias("arm"),
        (nine(F.get(obs, g)) > limit).alias("state"),
        F.when(same, nine(F.get(act, g)) > limit).alias("command"),
        F.when(same, nine(F.array_max(V.vec_absdiff(act, obs)))).alias("gap"),
    )


def moving_cutoffs(velocities: DataFrame) -> DataFrame:
    return exact_quantiles(velocities, EPISODE, "arm_velocity", {"q": MOVING_QUANTILE}).select(
        *EPISODE, nine(F.col("q")).alias("move_cutoff")
    )


def stall_cutoffs(moved: DataFrame) -> DataFrame:
    """Limit of the command gap: twice its level while quiet, or its own 95th percentile, whichever is larger."""
    quiet = F.when(F.coalesce(~F.col("moving"), F.lit(True)), F.col("gap"))
    both = moved.where(F.col("gap").isNotNull()).select(
        *EPISODE,
        F.explode(
            F.array(
                F.struct(F.lit("quiet").alias("kind"), quiet.alias("x")),
                F.struct(F.lit("all").alias("kind"), F.col("gap").alias("x")),
            )
        ).alias("k"),
    ).select(*EPISODE, "k.kind", "k.x")
    levels = exact_quantiles(
        both, [*EPISODE, "kind"], "x", {"noise": NOISE_QUANTILE, "high": STALL_QUANTILE}
    )
    return levels.groupBy(*EPISODE).agg(
        nine(
            F.greatest(
                F.coalesce(F.max(F.when(F.col("kind") == "quiet", F.col("noise"))), F.lit(0.0)) * NOISE_FACTOR,
                F.max(F.when(F.col("kind") == "all", F.col("high"))),
            )
        ).alias("stall_cutoff")
    )


def derive_signals(frames: DataFrame, separations: DataFrame | None = None) -> Signals:
    """All per-frame signals: velocity, moving, state, command, slip, stall, segment number.

    Three tables are staged on the way, each read by several branches; each carries only the columns still needed.
    """
    grippers = stage(discover_gripper(separations if separations is not None else otsu(frames)))
    base = gripper_frames(frames, grippers)
    speed = {
        "arm_velocity": lambda w: F.when(
            F.lag("frame_index").over(w).isNotNull(), nine(V.vec_distance(F.col("arm"), F.lag("arm").over(w)))
        )
    }
    # One block per episode: its windows need neither copies of rows nor sums of earlier blocks, and share one shuffle.
    short = (frames.agg(F.max("frame_index")).first()[0] or 0) < block_rows(frames.sparkSession)
    velocities = stage(with_neighbours(base, 1, 0, speed, short=short))
    move = moving_cutoffs(velocities)
    moved = stage(
        velocities.join(move, list(EPISODE), "left").withColumn(
            "moving", F.col("arm_velocity") > F.col("move_cutoff")
        )
    )
    stalls = stage(stall_cutoffs(moved))
    mismatch = F.coalesce(F.col("command") != F.col("state"), F.lit(False))
    judged = moved.join(stalls, list(EPISODE), "left").withColumns(
        {"mismatch": mismatch, "stall": F.coalesce(F.col("gap") > F.col("stall_cutoff"), F.lit(False))}
    )

    around = [k for k in range(1 - SLIP_FRAMES, SLIP_FRAMES) if k]
    beside = {
        f"_m{k}": (lambda w, k=k: F.coalesce((F.lag("mismatch", -k) if k < 0 else F.lead("mismatch", k)).over(w), F.lit(False)))
        for k in around
    }
    beside["_next_moving"] = lambda w: F.lead("moving").over(w)
    beside["previous_state"] = lambda w: F.lag("state").over(w)
    neighbours = with_neighbours(judged, SLIP_FRAMES - 1, SLIP_FRAMES - 1, beside, short=short)

    def held(start: int) -> Column:
        cells = [F.col(f"_m{k}") if k else F.col("mismatch") for k in range(start, start + SLIP_FRAMES)]
        return reduce(and_, cells)

    # A frame lies in a run of three when one of the windows of that length around it mismatches throughout.
    slip = reduce(or_, [held(start) for start in range(1 - SLIP_FRAMES, 1)])
    move_full = F.coalesce(F.col("moving"), F.col("_next_moving"), F.lit(False))
    slipped = neighbours.withColumns({"slip": slip, "move_full": move_full}).drop(
        "_next_moving", *[f"_m{k}" for k in around]
    )
    flips = with_neighbours(
        slipped, 1, 0,
        {
            "begins": lambda w: (
                (F.col("previous_state") != F.col("state")) | (F.lag("move_full").over(w) != F.col("move_full"))
            )
        },
        short=short,
    )
    begins = F.coalesce(F.col("begins"), F.lit(False)).cast("long")
    # The flags are staged before segments are numbered where the running total reads them twice.
    flagged = flips if short else stage(flips)
    numbered = running_total(flagged, EPISODE, ["frame_index"], frame_block(flips), begins, "segment", short)
    cutoffs = move.join(stalls, list(EPISODE), "left")
    return Signals(grippers, cutoffs, stage(numbered.drop("begins", "move_cutoff", "stall_cutoff", "mismatch")))


def segments(signals: DataFrame) -> DataFrame:
    """Segments ``[start_frame, end_frame)`` between change points, tagged by what is seen in them.

    ``dominant_joint`` counts the arm's joints, that is without the gripper.
    """
    first, last = F.min_by("arm", "frame_index"), F.max_by("arm", "frame_index")
    grouped = signals.groupBy(*EPISODE, "segment").agg(
        F.min("frame_index").alias("start_frame"),
        (F.max("frame_index") + 1).alias("end_frame"),
        (F.avg(F.col("move_full").cast("double")) >= MOVE_SHARE).alias("moving"),
        F.bool_or("state").cast("int").alias("gripper_state"),
        F.min_by("previous_state", "frame_index").alias("_before"),
        first.alias("_first"),
        last.alias("_last"),
        F.bool_or("slip").alias("has_slip"),
        F.bool_or("stall").alias("has_stall"),
    )
    change = (F.col("start_frame") > 0) & (F.col("_before").cast("int") != F.col("gripper_state"))
    shift = V.vec_absdiff(F.col("_last"), F.col("_first"))
    return grouped.withColumns(
        {
            "tag": F.when(F.coalesce(change, F.lit(False)), "grip-change").when(F.col("moving"), "move").otherwise("settle"),
            "travel": V.vec_distance(F.col("_last"), F.col("_first")),
            "dominant_joint": V.vec_argmax(F.transform(shift, nine)),
        }
    ).drop("_before", "_first", "_last")


def episode_features(signals: DataFrame, segment_rows: DataFrame, tracking: DataFrame) -> DataFrame:
    """One row per episode with the evidence a verdict rests on: counts, the fingerprint, and its segment tags."""
    per_frame = signals.groupBy(*EPISODE).agg(
        F.count(F.lit(1)).alias("frames"),
        F.bool_or("slip").alias("grip_slip"),
        F.count_if("slip").alias("n_slip"),
        F.count_if("stall").alias("n_stall"),
        F.count_if(~F.col("moving")).alias("n_settle"),
    )
    per_segment = segment_rows.groupBy(*EPISODE).agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count_if(F.col("tag") == "move").alias("n_move"),
        F.array_sort(F.collect_set("tag")).alias("tags"),  # three tags at most
    )
    worst = tracking.groupBy(*EPISODE).agg(
        F.max("max_error").alias("max_tracking_error"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("joint", "max_error")))).alias("tracking_error"),  # one entry per joint
    )
    return (
        per_frame.join(per_segment, list(EPISODE))
        .join(worst, list(EPISODE), "left")
        .withColumn("max_tracking_error", F.coalesce("max_tracking_error", F.lit(0.0)))
        .withColumn("tracking_error", F.coalesce("tracking_error", F.create_map().cast("map<int,double>")))
    )
