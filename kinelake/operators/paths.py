"""Paths in space and repair of joint series: spikes, duplicates, gaps, short pieces, outliers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.functions import vectors as V
from kinelake.operators.blocks import (
    EPISODE,
    carry,
    dense_index,
    exact_quantiles,
    frame_block,
    running_total,
    with_neighbours,
)
from kinelake.operators.windows import run_ids
from kinelake.session import hot_rows, stage

# --- fixed values -------------------------------------------------------------------------------------------------
JUMP_FACTOR = 8.0
RANGE_FACTOR = 12.0
RANGE_JUMPS = 4.0
RETURN_FACTOR = 2.0
STEP_FLOOR = 1e-4
REPAIR_FLOOR = 1e-6
STILL_STEP = 1e-9
MIN_PATH = 4
PIECE_MIN, PIECE_MAX, PIECE_SHARE = 8, 30, 0.02
# ------------------------------------------------------------------------------------------------------------------

AXES = ("x", "y", "z")


def gap(a: str, b: str) -> Column:
    """Distance between two points held as structs."""
    return F.sqrt(sum((F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) * (F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) for k in AXES))


def point() -> Column:
    return F.struct(*AXES)


def reindex(df: DataFrame, keys: Sequence[str] = EPISODE, index: str = "frame_index") -> DataFrame:
    """Number the rows that are left without gaps; the old index stays as ``source_index``."""
    kept = df if "source_index" in df.columns else df.withColumn("source_index", F.col(index))
    placed = dense_index(kept, keys, [index], frame_block(kept, index), "_i")
    return placed.withColumn(index, F.col("_i")).drop("_i")


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Lower median of ``value`` and lower median of the distances from it, per group.

    Each median reads its input twice and the second builds on the first, so callers hand in a staged table and the
    first result is staged here.
    """
    centre = stage(exact_quantiles(df, keys, value, {"centre": 0.5}, interpolate=False).select(*keys, "centre"))
    gaps = df.join(centre, list(keys)).select(*keys, F.abs(F.col(value) - F.col("centre")).alias("_gap"))
    return centre.join(
        exact_quantiles(gaps, keys, "_gap", {"mad": 0.5}, interpolate=False).select(*keys, "mad"), list(keys)
    )


def jump_limit(floor: float) -> Column:
    return F.greatest(F.col("centre") * JUMP_FACTOR, F.col("centre") + F.col("mad") * JUMP_FACTOR, F.lit(floor))


def steps(points: DataFrame) -> DataFrame:
    """Distance of each point to the one before (NULL on the first)."""
    here = points.withColumn("_p", point())
    return with_neighbours(here, 1, 0, {"_q": lambda w: F.lag("_p").over(w)}).withColumn("step", gap("_p", "_q")).drop("_p", "_q")


CHAIN = [f"{a}{k}" for a in ("p", "a") for k in AXES]
KEPT = "struct<x:double,y:double,z:double>"


def follow_block(kept: tuple[float, float, float], limit: float, points: list, after: list) -> tuple[tuple[float, float, float], list[int]]:
    """The last kept point behind a block and the places of its spikes, given the last kept point before it."""
    gone = []
    for i, (p, a) in enumerate(zip(points, after, strict=True)):
        x, y, z = kept
        if math.sqrt((x - p[0]) * (x - p[0]) + (y - p[1]) * (y - p[1]) + (z - p[2]) * (z - p[2])) > limit and (
            math.sqrt((x - a[0]) * (x - a[0]) + (y - a[1]) * (y - a[1]) + (z - a[2]) * (z - a[2])) <= limit * RETURN_FACTOR
        ):
            gone.append(i)
        else:
            kept = p
    return kept, gone


def follow_runs(doubtful: DataFrame) -> DataFrame:
    """(episode, frame_index) of the spikes among the rows of each ``run``, cut into blocks ``_part``.

    Each block follows its points from an assumed last kept point: at first the point right before it, as if that one had been
    kept. A kept point makes what came before it forgotten, so nearly every block leaves the same point behind whatever it was
    given. Blocks whose predecessor left another point than they assumed are done again, until all assumptions hold; a round
    touches those blocks only. No run is gathered, however many points jump.
    """
    key = [*EPISODE, "run", "_part"]
    flat = [F.col(f"_p.{k}").alias(f"p{k}") for k in AXES] + [F.col(f"_after.{k}").alias(f"a{k}") for k in AXES]
    row = F.struct("frame_index", F.struct(*[F.col(f"_before.{k}").alias(k) for k in AXES]).alias("_before"), *flat)
    blocks = doubtful.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("_c"), F.first("_limit").alias("_limit"))
    blocks = stage(
        blocks.select(*key, "_limit", F.get("_c", F.lit(0))["_before"].cast(KEPT).alias("assumed"), F.col("_c.frame_index").alias("at"), *[F.col(f"_c.{c}").alias(c) for c in CHAIN])
    )
    kinds = dict(doubtful.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + f", assumed {KEPT}, left {KEPT}, gone array<bigint>"

    def follow(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            left, gone = [], []
            for r in part.to_pylist():
                points, after = (list(zip(*(r[f"{a}{k}"] for k in AXES), strict=True)) for a in ("p", "a"))
                kept, places = follow_block(tuple(r["assumed"][k] for k in AXES), r["_limit"], points, after)
                left.append(dict(zip(AXES, kept, strict=True)))
                gone.append([r["at"][i] for i in places])
            kind = pa.struct([(k, pa.float64()) for k in AXES])
            columns = [*[part.column(k) for k in key], part.column("assumed"), pa.array(left, kind), pa.array(gone, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "assumed", "left", "gone"])

    done = stage(blocks.mapInArrow(follow, schema))
    while True:
        before = Window.partitionBy(*EPISODE, "run").orderBy("_part")
        held = done.select(*key, "assumed", F.lag("left").over(before).alias("given"))
        wrong = stage(held.where(F.col("given").isNotNull() & (F.col("given") != F.col("assumed"))).select(*key, F.col("given").alias("assumed")))
        if wrong.isEmpty():
            return done.select(*EPISODE, F.explode("gone").alias("frame_index"))
        again = blocks.drop("assumed").join(wrong, key).select(*blocks.columns).mapInArrow(follow, schema)
        done = stage(done.join(wrong.select(*key), key, "left_anti").unionByName(again))


def reject_spikes(points: DataFrame) -> DataFrame:
    """Drop isolated spikes: far from the last kept point and from the next one, while those two are close.

    Points that are not finite go first; a path of fewer than four points stays. The first and last point always stay.
    Only a point followed by a jump can be a spike, so any other point is kept for certain and starts afresh: the
    recursion over kept points runs inside each run of consecutive jumps, and there block by block (``follow_runs``).
    """
    finite = points.where(V.is_finite(F.col("x")) & V.is_finite(F.col("y")) & V.is_finite(F.col("z")))
    stepped = stage(steps(reindex(finite)).withColumn("_p", point()))
    limits = spread(stepped.where(F.col("step").isNotNull()), EPISODE, "step").select(
        *EPISODE, jump_limit(STEP_FLOOR).alias("_limit")
    )
    sizes = stepped.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("_n"))
    limited = stepped.join(stage(sizes.join(limits, list(EPISODE), "left")), list(EPISODE))
    around = with_neighbours(
        limited,
        1,
        1,
        {
            "_before": lambda w: F.lag("_p").over(w),
            "_after": lambda w: F.lead("_p").over(w),
            "_next_step": lambda w: F.lead("step").over(w),
        },
    )
    inner = (F.col("frame_index") > 0) & (F.col("frame_index") < F.col("_n") - 1) & (F.col("_n") >= MIN_PATH)
    doubtful = around.withColumn("_doubt", inner & F.coalesce(F.col("_next_step") > F.col("_limit"), F.lit(False)))
    numbered = run_ids(doubtful, "_doubt").where(F.col("run").isNotNull())
    dropped = follow_runs(numbered.withColumn("_part", frame_block(numbered)))
    return (
        stepped.drop("step", "_p")
        .join(dropped, [*EPISODE, "frame_index"], "left_anti")
        .withColumn("frame_index", F.col("source_index"))
        .drop("source_index")
    )


def dedupe_consecutive(points: DataFrame) -> DataFrame:
    """Drop points equal to the one before."""
    here = reindex(points).withColumn("_p", point())
    same = {"_same": lambda w: F.coalesce(F.lag("_p").over(w) == F.col("_p"), F.lit(False))}
    return (
        with_neighbours(here, 1, 0, same)
        .where(~F.col("_same"))
        .withColumn("frame_index", F.col("source_index"))
        .drop("_p", "_same", "source_index")
    )


def split_path(points: DataFrame) -> DataFrame:
    """Cut a path at unusual gaps; adds ``piece``, ``cut`` (starts a piece after a gap), ``threshold``, ``piece_points``.

    The threshold comes from the steps that move at all. Pieces of a single point are left out, and so is a path that
    never moves.
    """
    stepped = stage(steps(reindex(points)))
    moving = stepped.where(F.col("step") > STILL_STEP)
    limits = stage(spread(moving, EPISODE, "step").select(*EPISODE, jump_limit(STEP_FLOOR).alias("threshold")))
    limited = stepped.join(limits, list(EPISODE)).withColumn(
        "cut", F.coalesce(F.col("step") > F.col("threshold"), F.lit(False))
    )
    pieced = running_total(
        limited, EPISODE, ["frame_index"], frame_block(limited), F.col("cut").cast("long"), "piece"
    )
    sizes = pieced.groupBy(*EPISODE, "piece").agg(F.count(F.lit(1)).alias("piece_points"))
    return (
        pieced.join(sizes.where(F.col("piece_points") >= 2), [*EPISODE, "piece"])
        .withColumn("frame_index", F.col("source_index"))
        .drop("source_index")
    )


def path_cuts(points: DataFrame) -> DataFrame:
    """Number of cuts, pieces and the threshold of each path that moves."""
    stepped = stage(steps(reindex(points)))
    limits = spread(stepped.where(F.col("step") > STILL_STEP), EPISODE, "step").select(
        *EPISODE, jump_limit(STEP_FLOOR).alias("threshold")
    )
    return (
        stepped.join(limits, list(EPISODE))
        .groupBy(*EPISODE)
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.count_if(F.col("step") > F.col("threshold")).alias("cuts"),
            F.first("threshold").alias("threshold"),
        )
    )


def minimum_points(total: Column) -> Column:
    share = F.ceil(total * F.lit(PIECE_SHARE)).cast("long")
    wanted = F.least(total, F.greatest(F.lit(PIECE_MIN), F.least(F.lit(PIECE_MAX), share)))
    return F.when(total < MIN_PATH, F.lit(MIN_PATH)).otherwise(wanted).cast("long")


def keep_segments(pieces: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds ``kept`` to the rows of a split path: whether their piece is long enough for a path of ``total`` points.

    ``totals``: episode key and ``total``.
    """
    need = totals.select(*EPISODE, "total", minimum_points(F.col("total")).alias("minimum_points"))
    return pieces.join(need, list(EPISODE)).withColumn(
        "kept", (F.col("total") >= MIN_PATH) & (F.col("piece_points") >= F.col("minimum_points"))
    )


def clean_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spikes and duplicates removed, split, short pieces marked: (point rows with ``kept``, totals)."""
    spikeless = stage(reject_spikes(points.select(*EPISODE, "frame_index", *AXES)))
    cleaned = stage(dedupe_consecutive(spikeless))
    totals = cleaned.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("total"))
    return stage(keep_segments(split_path(cleaned), totals)), totals


def clean_path(points: DataFrame) -> DataFrame:
    """What the cleaned path of each episode comes to: built, discarded (only short pieces) or stationary."""
    marked, totals = clean_points(points)
    pieces = marked.groupBy(*EPISODE, "piece").agg(F.max("kept").alias("_kept"))
    counts = pieces.groupBy(*EPISODE).agg(
        F.count_if("_kept").alias("segments"), F.count_if(~F.col("_kept")).alias("discarded_fragments")
    )
    joined = totals.join(counts, list(EPISODE), "left").fillna(0, ["segments", "discarded_fragments"])
    return joined.withColumn(
        "outcome",
        F.when(F.col("segments") > 0, "built").when(F.col("discarded_fragments") > 0, "discarded").otherwise("stationary"),
    )


def sanitize(values: DataFrame, keys: Sequence[str] = (*EPISODE, "channel", "joint")) -> DataFrame:
    """Repair non-finite values and isolated outliers of joint series (long form: ``frame_index``, ``value``).

    Adds ``repaired`` (whether the value was replaced). Limits scale with each series; the neighbours a point is judged
    by are the raw ones. A repaired value lies on the line between the nearest good frames, else equals the nearest one,
    else the median; a series without any finite value becomes 0.

    An ordinary series is repaired in one task; one above ``hot_rows`` frames goes block by block (``_sanitize_blocks``). Both
    follow the same formulas, so the size does not show.
    """
    keys = list(keys)
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = hot_rows(values.sparkSession)
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= most:
        return _sanitize_series(values, keys)
    large = stage(sizes.where(F.col("_n") > most).select(*keys))
    return _sanitize_series(values.join(large, keys, "left_anti"), keys).unionByName(_sanitize_blocks(values.join(large, keys, "left_semi"), keys))


def lower_median(values: np.ndarray) -> float:
    """The middle value, of two the smaller one; NaN without any."""
    return float(np.sort(values)[(len(values) + 1) // 2 - 1]) if len(values) else math.nan


def repaired_series(frame: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repaired values of one series in order of frames, and which were replaced; what is not finite counts as missing."""
    v = np.where(np.isfinite(given), given, np.nan)
    before, after = np.concatenate([[np.nan], v[:-1]]), np.concatenate([v[1:], [np.nan]])
    steps = np.abs(v - before)
    known, steps = v[~np.isnan(v)], steps[~np.isnan(steps)]
    centre = lower_median(known)
    mad = lower_median(np.abs(known - centre))
    typical = lower_median(steps)
    jump = REPAIR_FLOOR
    if len(steps):
        jump = max(typical * JUMP_FACTOR, typical + lower_median(np.abs(steps - typical)) * JUMP_FACTOR, REPAIR_FLOOR)
    usual = max(0.0 if math.isnan(mad) else mad * RANGE_FACTOR, jump * RANGE_JUMPS, REPAIR_FLOOR)
    far = (np.abs(v - before) > jump) & (np.abs(v - after) > jump) & (np.abs(before - after) <= jump * RETURN_FACTOR)
    stray = (np.abs(v - centre) > usual) & (np.abs(before - centre) <= usual) & (np.abs(after - centre) <= usual)
    bad = np.isnan(v) | far | stray
    good = np.flatnonzero(~bad)
    if not len(good):
        return np.full(len(v), 0.0 if math.isnan(centre) else centre), bad
    place = np.searchsorted(good, np.arange(len(v)), "right")
    left, right = good[np.maximum(place - 1, 0)], good[np.minimum(place, len(good) - 1)]
    share = (frame - frame[left]) / np.where(frame[right] > frame[left], frame[right] - frame[left], 1).astype(float)
    between = v[left] + (v[right] - v[left]) * share
    filled = np.where(place == 0, v[right], np.where(place == len(good), v[left], between))
    return np.where(bad, filled, v), bad


def _sanitize_series(values: DataFrame, keys: list[str]) -> DataFrame:
    typed = values.withColumn("value", F.col("value").cast("double"))
    schema = T.StructType([*typed.schema.fields, T.StructField("repaired", T.BooleanType())])

    def repair(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_index")
        given = np.array(table.column("value").to_numpy(zero_copy_only=False), dtype=float)
        fixed, bad = repaired_series(table.column("frame_index").to_numpy(), given)
        at = table.schema.get_field_index("value")
        return table.set_column(at, "value", pa.array(fixed)).append_column("repaired", pa.array(bad))

    return typed.groupBy(*keys).applyInArrow(repair, schema)


def _sanitize_blocks(values: DataFrame, keys: list[str]) -> DataFrame:
    raw = values.withColumn("_v", F.when(V.is_finite(F.col("value")), F.col("value")))
    beside = with_neighbours(
        raw, 1, 1, {"_prev": lambda w: F.lag("_v").over(w), "_next": lambda w: F.lead("_v").over(w)}, keys
    ).withColumn("_step", F.abs(F.col("_v") - F.col("_prev")))
    beside = stage(beside)
    kinds = beside.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("value").alias("kind"), F.col("_v").alias("x")),
                F.struct(F.lit("step").alias("kind"), F.col("_step").alias("x")),
            )
        ).alias("_k"),
    ).select(*keys, "_k.kind", "_k.x")
    stats = stage(spread(kinds.where(F.col("x").isNotNull()), [*keys, "kind"], "x"))
    of_values = stats.where(F.col("kind") == "value").select(*keys, F.col("centre").alias("_centre"), F.col("mad").alias("_mad"))
    of_steps = stats.where(F.col("kind") == "step").select(*keys, jump_limit(REPAIR_FLOOR).alias("_jump"))
    limits = of_values.join(of_steps, keys, "left").withColumn(
        "_jump", F.coalesce("_jump", F.lit(REPAIR_FLOOR))
    )
    limited = beside.join(limits, keys, "left")
    v, p, n = F.col("_v"), F.col("_prev"), F.col("_next")
    usual = F.greatest(F.col("_mad") * RANGE_FACTOR, F.col("_jump") * RANGE_JUMPS, F.lit(REPAIR_FLOOR))
    jump = (
        (F.abs(v - p) > F.col("_jump"))
        & (F.abs(v - n) > F.col("_jump"))
        & (F.abs(p - n) <= F.col("_jump") * RETURN_FACTOR)
    )
    stray = (
        (F.abs(v - F.col("_centre")) > usual)
        & (F.abs(p - F.col("_centre")) <= usual)
        & (F.abs(n - F.col("_centre")) <= usual)
    )
    flagged = limited.withColumn("repaired", v.isNull() | F.coalesce(jump | stray, F.lit(False)))
    flagged = stage(flagged)
    good = F.when(~F.col("repaired"), F.struct(F.col("frame_index").alias("i"), v.alias("v")))
    block = frame_block(flagged)
    ahead = carry(flagged, keys, ["frame_index"], block, {"_b": good})
    both = carry(ahead, keys, ["frame_index"], block, {"_a": good}, forward=False)
    share = (F.col("frame_index") - F.col("_b.i")) / (F.col("_a.i") - F.col("_b.i")).cast("double")
    filled = F.coalesce(
        F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * share, F.col("_b.v"), F.col("_a.v"), F.col("_centre"), F.lit(0.0)
    )
    return both.withColumn("value", F.when(F.col("repaired"), filled).otherwise(v)).drop(
        "_v", "_prev", "_next", "_step", "_centre", "_mad", "_jump", "_a", "_b"
    )
