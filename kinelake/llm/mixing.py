"""Mixing sources to target weights: budgets fitted by a bounded knapsack over exact document lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import WORD, stage

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 20
#: Longest documents that the knapsack fits together, within so many words.
RESERVE, RESERVE_WORDS = 8, 1 << 22
#: Rows ranked together; a length that more documents of one source share is cut into this many rows by hash.
BUCKET_ROWS = 256


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(sizes: pd.DataFrame, weights: Sequence[float], most: float, share: float) -> np.ndarray:
    """Targets in proportion to weight; one above ``most`` times its size stops there and its excess is dealt again."""
    size = sizes["source_size"].to_numpy(float)
    weight = np.array([weights[i % len(weights)] for i in range(len(size))], float)
    budget, cap, target, open_ = share * size.sum(), most * size, np.zeros(len(size)), np.ones(len(size), bool)
    while open_.any():
        left = budget - target[~open_].sum()
        target[open_] = left * weight[open_] / weight[open_].sum()
        over = open_ & (target > cap)
        if not over.any():
            break
        target[over], open_[over] = cap[over], False
    return target


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` from below as can be.

    First every length gets its even share of all but a reserve of some longest documents, rounded so that the running total
    follows the wanted total. A bounded knapsack over the documents still free fills the reserve: ``first[s]`` is the bundle
    that first reached the sum ``s``, and walking it back gives the counts. A budget within the reserve is fitted at its best.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    longest = int(lengths.max())
    even = budget - min(budget, max(longest, min(RESERVE * longest, RESERVE_WORDS)))
    taken, done, wanted = np.zeros_like(counts), 0, 0.0
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        if length == 0:
            continue
        wanted += length * count * (even / total)
        taken[i] = min(count, max(0, int((min(wanted, even) - done) // length)))
        done += int(taken[i]) * length
    rest = budget - done
    first = np.full(rest + 1, -1, np.int64)
    first[0] = 0
    bundles: list[tuple[int, int]] = [(0, 0)]
    for i in np.argsort(-lengths, kind="stable"):
        free, length, size = int(counts[i] - taken[i]), int(lengths[i]), 1
        if not 0 < length <= rest:
            continue
        free = min(free, rest // length)
        while free > 0 and first[rest] < 0:
            size = min(size, free)
            weight = size * length
            new = np.flatnonzero((first[: rest + 1 - weight] >= 0) & (first[weight:] < 0)) + weight
            bundles.append((int(i), size))
            first[new] = len(bundles) - 1
            free, size = free - size, size * 2
        if first[rest] >= 0:
            break
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        i, size = bundles[first[at]]
        taken[i] += size
        at -= size * int(lengths[i])
    return taken


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MAX_REPEATS, share: float = 1.0, seed: int = SEED
) -> DataFrame:
    """One row per document: how often the mix takes it, and the sizes behind that.

    Columns: doc_id, source, content (hash of the row's id and text), size, source_size, target, copies, taken.
    Whole passes over a source come first; the rest of its budget is fitted by length and drawn by seeded hash. A null text
    has size 0, a null source is a source of its own (last in order), documents without words are taken with 0 words, and
    equal rows are drawn separately. Whether text, id or source is null, the row is kept. One row per source and per
    distinct length of a source meets in a task, never the documents themselves.
    """
    rows = stage(
        docs.select(
            "doc_id", "source",
            F.when(F.col("source").isNull(), "~").otherwise(F.concat(F.lit("s"), "source")).alias("key"),
            n_words(F.col("text")).alias("size"),
            F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")), F.col("source")).alias("content"),
        )
    )
    lengths = stage(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))

    def targets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(parts)
        if found:
            # Null sources have the key "~", all others start with "s": code point order with null last.
            table = pd.concat(found)
            table = table.iloc[np.argsort([k.encode() for k in table["key"]], kind="stable")].reset_index(drop=True)
            yield table.assign(target=water_fill(table, weights, most, share))

    # One row per source, a catalogue that one task orders.
    wanted = sizes.coalesce(1).mapInPandas(targets, "key string, source_size long, target double")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        total, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        budget = int(target)
        passes, rest = (budget // total, budget % total) if total else (0, 0)
        length, count = part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        drawn = fit_budget(length, count, rest) if rest else np.zeros_like(count)
        return part[["key", "size", "n", "source_size", "target"]].assign(passes=passes, drawn=drawn)

    plan = stage(
        lengths.join(wanted, "key").groupBy("key").applyInPandas(
            fit, "key string, size long, n long, source_size long, target double, passes long, drawn long"
        )
    )
    # A plain join, so that adaptive execution may split a length which many documents share.
    order = F.xxhash64(F.lit(seed), "content")
    dealt = (
        rows.join(plan, ["key", "size"])
        .withColumn("order", order)
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "content"), F.ceil(F.col("n") / BUCKET_ROWS)))
    )
    cells = dealt.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("ahead", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    inside = Window.partitionBy("key", "size", "bucket").orderBy("order", "content")
    ranked = dealt.withColumn("rank", F.row_number().over(inside)).join(offsets, ["key", "size", "bucket"])
    copies = F.col("passes") + F.when(F.col("ahead") + F.col("rank") <= F.col("drawn"), 1).otherwise(0)
    return ranked.select(
        "doc_id", "source", "content", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it, with unchanged columns.

    Equal rows are told apart by their place among rows of one content, so that each gets one of the decisions.
    """
    content = F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")), F.col("source"))
    place = Window.partitionBy("__content").orderBy(F.lit(0))
    chosen = (
        mix(docs.select("doc_id", "source", "text"), **options)
        .select(F.col("content").alias("__content"), F.col("copies").alias("__copies"))
        .withColumn("__place", F.row_number().over(Window.partitionBy("__content").orderBy("__copies")))
    )
    marked = docs.withColumn("__content", content).withColumn("__place", F.row_number().over(place))
    return (
        marked.join(chosen.where("__copies > 0"), ["__content", "__place"])
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
        .select(*docs.columns)
    )
