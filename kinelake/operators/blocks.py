"""Ordered computations over long groups, split into bounded blocks.

A window partitioned by episode puts a whole episode into one task. Here an ordered group is cut into blocks of
consecutive rows, every window is partitioned by (group, block), and what must cross a block edge travels separately:

* ``add_halo`` copies the few rows next to an edge into the neighbouring block (lag/lead, FIR filters);
* ``running_total`` adds the sum of all earlier blocks (ranks, run ids, segment ids);
* ``carry`` adds the last value of earlier blocks (as-of joins, gap filling);
* ``exact_quantiles`` brackets the wanted ranks first, then orders only the rows inside the bracket.

One row per block is all that is ever gathered per group, so one episode may hold a third of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinelake.session import block_rows, hot_rows, stage

EPISODE = ("dataset_id", "episode_index")
BLOCK = "_block"
HOME = "_home"


def frame_block(df: DataFrame, index: str = "frame_index", rows: int | None = None) -> Column:
    return F.floor(F.col(index) / F.lit(rows or block_rows(df.sparkSession))).cast("long")


def add_halo(df: DataFrame, before: int, after: int, index: str = "frame_index", rows: int | None = None) -> DataFrame:
    """Give each block the ``before`` rows ahead of it and the ``after`` rows behind it (``_home`` is false there).

    ``index`` must be dense within its group. A halo wider than a block would have to reach past the neighbour, so
    the block grows with the halo.
    """
    size = max(rows or block_rows(df.sparkSession), before, after, 1)
    block = F.floor(F.col(index) / F.lit(size)).cast("long")
    offset = F.pmod(F.col(index), F.lit(size))
    copies = [F.struct(block.alias("b"), F.lit(True).alias("h"))]
    if before:
        copies.append(F.when(offset >= size - before, F.struct((block + 1).alias("b"), F.lit(False).alias("h"))))
    if after:
        reach = (offset < after) & (block > 0)
        copies.append(F.when(reach, F.struct((block - 1).alias("b"), F.lit(False).alias("h"))))
    return (
        df.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
        .withColumn(BLOCK, F.col("_copy.b"))
        .withColumn(HOME, F.col("_copy.h"))
        .drop("_copy")
        # A halo copy behind the last block of an episode opens a block without rows of its own.
    )


def short_groups(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no group has more rows than a block; one count of the keys decides.

    Such groups are windows of their own: one shuffle of the rows does, with no blocks to be joined to their summaries.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (sizes.agg(F.max("_n")).first()[0] or 0) <= block_rows(df.sparkSession)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col(HOME)).drop(HOME, BLOCK)


def block_window(keys: Sequence[str] = EPISODE, index: str = "frame_index") -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(index)


def with_neighbours(
    df: DataFrame, before: int, after: int, columns: dict, keys: Sequence[str] = EPISODE, index: str = "frame_index",
    short: bool = False,
) -> DataFrame:
    """Add window columns that look at most ``before``/``after`` rows away.

    ``columns`` maps a name to a function of the ordered window. A neighbour that an expression uses more than once
    should be a column of its own: every mention of a window function is evaluated separately. ``short`` groups need no halo.
    """
    if short:
        whole = Window.partitionBy(*keys).orderBy(index)
        return df.withColumns({name: make(whole) for name, make in columns.items()})
    window = block_window(keys, index)
    haloed = add_halo(df, before, after, index)
    return drop_halo(haloed.withColumns({name: make(window) for name, make in columns.items()}))


def join_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give each row what its block's summary holds; keys may be NULL, and no row is lost to that."""
    named = summary.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return rows.join(named, same, "left").drop(*[f"_k_{k}" for k in keys])


RANGE = "_range"


def bounded_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> tuple[DataFrame, Column]:
    """The rows and a block for each that holds a bounded number of a group's rows, however they bunch along ``order``.

    ``block`` (of time, say) serves where no block of a group exceeds ``hot_rows``; one count decides. Otherwise the rows are
    cut at splitters of equal depth: Spark samples the order of (keys, order) and each range of about ``block_rows`` rows is a
    block. The ranges are written once, so every reader sees the same ones. Only callers that drop ``RANGE`` see a clean table.
    """
    spark = df.sparkSession
    sizes = df.groupBy(*keys, block.alias(BLOCK)).agg(F.count(F.lit(1)).alias("_n"))
    largest, rows = sizes.agg(F.max("_n"), F.sum("_n")).first()
    if (largest or 0) <= hot_rows(spark):
        return df, block
    cut = df.repartitionByRange(-(-rows // block_rows(spark)), *keys, *order)
    return stage(cut.withColumn(RANGE, F.spark_partition_id().cast("long"))), F.col(RANGE)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, out: str, short: bool = False
) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order``; ``block`` must not decrease along ``order``. ``short`` groups need no block."""
    if short:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(whole))
    blocked = df.withColumn(BLOCK, block).withColumn("_v", value)
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, BLOCK)
        .agg(F.sum("_v").alias("_t"))
        .select(*keys, BLOCK, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_summary(blocked, offsets, [*keys, BLOCK])
        .withColumn(out, F.col("_offset") + F.sum("_v").over(within))
        .drop("_v", "_offset", BLOCK)
    )


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str, short: bool = False
) -> DataFrame:
    """Zero-based position of each row in its group; ties in ``order`` must not occur."""
    return running_total(df, keys, order, block, F.lit(1).cast("long"), out, short).withColumn(out, F.col(out) - 1)


def carry(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, values: dict, forward: bool = True
) -> DataFrame:
    """Last (or, backwards, next) non-null value at or beside each row. ``values`` maps out name -> column."""
    blocked = df.withColumn(BLOCK, block).withColumns({f"_c_{o}": v for o, v in values.items()})
    place = F.struct(*order)
    pick = F.max_by if forward else F.min_by
    summary = blocked.groupBy(*keys, BLOCK).agg(
        *[pick(F.col(f"_c_{o}"), F.when(F.col(f"_c_{o}").isNotNull(), place)).alias(f"_s_{o}") for o in values]
    )

    def facing(spec_order):
        return [F.col(c).asc() if forward else F.col(c).desc() for c in spec_order]

    outside = Window.partitionBy(*keys).orderBy(*facing([BLOCK])).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*facing(order)).rowsBetween(Window.unboundedPreceding, 0)
    carried = summary.select(
        *keys, BLOCK, *[F.last(f"_s_{o}", ignorenulls=True).over(outside).alias(f"_p_{o}") for o in values]
    )
    joined = join_summary(blocked, carried, [*keys, BLOCK])
    filled = {o: F.coalesce(F.last(f"_c_{o}", ignorenulls=True).over(inside), F.col(f"_p_{o}")) for o in values}
    helpers = [f"_{p}_{o}" for o in values for p in "cp"]
    return joined.withColumns(filled).drop(*helpers, BLOCK)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, out: str) -> DataFrame:
    """``value`` of the row before in ``order``, whatever gaps and repeats the order has; ``block`` must not decrease along it."""
    blocked = df.withColumn(BLOCK, block)
    place = F.struct(*order)
    last = blocked.groupBy(*keys, BLOCK).agg(F.max_by(F.struct(F.col(value).alias("v")), place).alias("_l"))
    outside = Window.partitionBy(*keys).orderBy(BLOCK)
    before = last.select(*keys, BLOCK, F.lag("_l").over(outside).alias("_l"))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    first = F.row_number().over(inside) == 1
    return (
        join_summary(blocked, before, [*keys, BLOCK])
        .withColumn(out, F.when(first, F.col("_l.v")).otherwise(F.lag(value).over(inside)))
        .drop("_l", BLOCK)
    )


# Ranks the sketch may be off by, as a share of the group: 1/accuracy by contract, four times that for the bracket.
SKETCH_ACCURACY = 20_000
BRACKET = 4.0 / SKETCH_ACCURACY


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], interpolate: bool = True
) -> DataFrame:
    """Exact quantiles per group, one row per group, plus the group's size ``_n``.

    ``interpolate`` gives ``(1 - fraction) * lo + fraction * hi`` between the two neighbouring ranks; without it the first element
    that at least the share ``p`` of the group does not exceed is taken (the lower median for 0.5).

    The built-in aggregate keeps every distinct value of a group in one task. Groups above ``hot_rows`` are told apart by a
    count and are ordered inside a bracket only. Both ways take the same ranks and weigh them by the same formula.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows(df.sparkSession))
    hot = stage(hot)
    if hot.isEmpty():
        return _direct_quantiles(rows, keys, probs, interpolate)
    named = hot.select(*keys)
    cold = _direct_quantiles(rows.join(named, keys, "left_anti"), keys, probs, interpolate)
    return cold.unionByName(
        _bracketed_quantiles(stage(rows.join(named, keys, "left_semi")), keys, probs, interpolate)
    )


def _direct_quantiles(rows: DataFrame, keys: list[str], probs: dict[str, float], interpolate: bool) -> DataFrame:
    names = list(probs)
    if interpolate:
        found = rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.percentile("_x", [probs[n] for n in names]).alias("_q")
        )
        return found.select(*keys, "_n", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    picks = [F.expr(f"percentile_disc({probs[n]!r}) WITHIN GROUP (ORDER BY _x)").alias(n) for n in names]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *picks)


def _bracketed_quantiles(rows: DataFrame, keys: list[str], probs: dict[str, float], interpolate: bool) -> DataFrame:
    """Quantiles of groups too large for one task.

    A sketch brackets each wanted rank; rows below the bracket are only counted, equal values inside it are merged, and
    only what is left is ordered. Groups whose bracket misses a rank are done again with one four times as wide, which in the
    end is all of the group.
    """
    found: DataFrame | None = None
    # Three ranks more on each side cover the neighbouring ranks themselves; every group here exceeds ``hot_rows``.
    reach = BRACKET + 3.0 / hot_rows(rows.sparkSession)
    while True:
        tried = stage(_bracketed_once(rows, keys, probs, interpolate, reach))
        whole = tried.where("not _missed").drop("_missed")
        found = whole if found is None else found.unionByName(whole)
        missed = stage(tried.where("_missed").select(*keys))
        if missed.isEmpty():
            return found
        named = missed.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        rows, reach = rows.join(named, same, "left_semi"), reach * 4


def _bracketed_once(
    rows: DataFrame, keys: list[str], probs: dict[str, float], interpolate: bool, reach: float
) -> DataFrame:
    cuts = sorted({min(1.0, max(0.0, p + d)) for p in probs.values() for d in (-reach, reach)})
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_x", F.array(*[F.lit(c) for c in cuts]), SKETCH_ACCURACY).alias("_cuts"),
    )

    def edge(at: float, open_end: float) -> Column:
        return F.get("_cuts", F.lit(cuts.index(at))).cast("double") if 0.0 < at < 1.0 else F.lit(open_end)

    brackets = F.array(
        *[
            F.struct(
                F.lit(name).alias("q"), F.lit(p).alias("p"),
                edge(p - reach, float("-inf")).alias("lo"), edge(p + reach, float("inf")).alias("hi"),
            )
            for name, p in probs.items()
        ]
    )
    ranges = stats.select(*keys, "_n", F.explode(brackets).alias("_b")).select(*keys, "_n", "_b.*")
    inside = (
        rows.join(ranges, keys)
        .where(F.col("_x") <= F.col("hi"))
        .groupBy(*keys, "q", "p", "_n", F.when(F.col("_x") >= F.col("lo"), F.col("_x")).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    rising = Window.partitionBy(*keys, "q").orderBy(F.col("_x").asc_nulls_first())
    upto = F.sum("_c").over(rising.rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("_hi_rank", upto).withColumn("_lo_rank", F.col("_hi_rank") - F.col("_c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo_rank") <= rank) & (rank < F.col("_hi_rank")), F.col("_x")))

    position = F.col("p") * (F.col("_n") - 1)
    if interpolate:
        low_rank = F.floor(position).cast("long")
        high_rank = F.least(low_rank + 1, F.col("_n") - 1)
    else:
        low_rank = F.greatest(F.lit(0), F.ceil(F.col("p") * F.col("_n")) - 1).cast("long")
        high_rank = low_rank
    picked = ranked.groupBy(*keys, "q").agg(
        F.first("_n").alias("_n"), at(low_rank).alias("_lo"), at(high_rank).alias("_hi"),
        F.first(position - low_rank).alias("_f"),
    )
    # The built-in aggregate's formula, so that a group's size doesn't show in the last digit.
    between = (1.0 - F.col("_f")) * F.col("_lo") + F.col("_f") * F.col("_hi")
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between) if interpolate else F.col("_lo")
    return picked.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col("q") == name, value)).alias(name) for name in probs],
        F.bool_or(F.col("_lo").isNull() | F.col("_hi").isNull()).alias("_missed"),
    )
