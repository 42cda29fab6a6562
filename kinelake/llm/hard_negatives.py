"""Hard negatives of anchor rows: exact integer scores by Kronecker-packed products, top rows merged over blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import stage

POSITIVES = NEGATIVES = 5
#: Of the positive's score, in hundredths: what a negative must reach and may not exceed.
LOW, HIGH = 80, 100
SCALE = 256
#: Rows of one group of the grid; a group is one call of the scoring function, so these bound its memory.
ANCHORS, CANDIDATES = 2048, 16384
STRIP = 128
LONG = np.iinfo(np.int64)


def quantised(vectors: list, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as integers, rows padded with zeros; Python integers where 64 bits could not hold the products."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if not out.size or np.abs(out).max() < 2.0**20:
        return np.floor(out * scale).astype(np.int64)
    exact = [[math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale for x in row] for row in out.tolist()]
    return np.array(exact, dtype=object).reshape(out.shape)


def span(values: np.ndarray) -> tuple[int, int]:
    """Least entry, and the largest above it."""
    low = int(values.min()) if values.size else 0
    return low, (int(values.max()) - low if values.size else 0)


def pack(candidates: np.ndarray, low: int, bits: int, fields: int) -> np.ndarray:
    """Entry (k, j): component k of ``fields`` candidates, each lifted by ``low`` into ``bits`` bits of its own."""
    count, width = candidates.shape
    lifted = np.zeros((-(-count // fields) * fields, width), candidates.dtype)
    lifted[:count] = candidates - low
    lifted = lifted.reshape(-1, fields, width)
    packed = lifted[:, 0].copy()
    for i in range(1, fields):
        packed += lifted[:, i] << (bits * i) if packed.dtype != object else lifted[:, i] * (1 << bits * i)
    return np.ascontiguousarray(packed.T)


class Products:
    """Inner products of any anchors with a fixed block of candidates.

    Both sides are lifted to be non-negative, so a sum of products fits in ``bits`` bits and never borrows from the field
    above. One multiplication by an anchor's component serves all candidates of a word; the lifts are taken out afterwards.
    """

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray):
        self.count, self.width = candidates.shape
        self.low, reach = span(candidates)
        self.anchor_low, anchor_reach = span(anchors)
        self.bits = max(1, (self.width * reach * anchor_reach).bit_length())
        large = max(abs(self.low), reach) * max(abs(self.anchor_low), anchor_reach) * 4 * max(self.width, 1) >= 1 << 62
        self.wide = candidates.dtype == object or anchors.dtype == object or self.bits > 63 or large
        self.fields = 8 if self.wide else 63 // self.bits
        held = candidates.astype(object) if self.wide else candidates
        self.packed = pack(held, self.low, self.bits, self.fields)
        self.sums = (held - self.low).sum(axis=1) if self.width else np.zeros(self.count, held.dtype)

    def of(self, anchors: np.ndarray) -> np.ndarray:
        """Scores, anchors by candidates; what 64 bits cannot hold becomes the nearest long."""
        lifted = (anchors.astype(object) if self.wide else anchors) - self.anchor_low
        totals = np.zeros((len(anchors), self.packed.shape[1]), lifted.dtype)
        for k in range(self.width):
            totals += lifted[:, k, None] * self.packed[k]
        mask, parts = (1 << self.bits) - 1, []
        for i in range(self.fields):
            parts.append((totals >> (self.bits * i)) & mask)
        scores = np.stack(parts, axis=2).reshape(len(anchors), -1)[:, : self.count]
        own = lifted.sum(axis=1) if self.width else np.zeros(len(anchors), lifted.dtype)
        scores = scores + self.anchor_low * self.sums + (self.low * own)[:, None] + self.width * self.anchor_low * self.low
        return np.clip(scores, LONG.min, LONG.max).astype(np.int64)


def first(scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores, equal ones in the order given."""
    places = np.arange(len(scores))
    if len(scores) > count:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    return places[np.argsort(-scores[places], kind="stable")][:count]


def bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score, held inside 64 bits."""
    least, most = -(-low * score // 100), high * score // 100
    return max(least, LONG.min), min(most, LONG.max)


def sides(table: pa.Table, scale: int) -> tuple:
    """Anchors (row places, ids, labels, components) and candidates, the latter by id."""
    ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
    asks, vectors = table.column("asks").to_numpy(zero_copy_only=False), table.column("v").to_pylist()
    width = max(map(len, vectors), default=0)
    a, c = np.flatnonzero(asks), np.flatnonzero(~asks)
    c = c[np.argsort(ids[c], kind="stable")]
    of = lambda rows: quantised([vectors[i] for i in rows], width, scale)
    return (a, ids[a], labels[a], of(a)), (ids[c], labels[c], of(c))


def best_positives(rows: pa.Table, count: int, scale: int) -> pa.Table:
    (_, ids, labels, anchors), (other_ids, other_labels, others) = sides(rows, scale)
    out: tuple[list, list, list] = ([], [], [])
    if len(ids) and len(other_ids):
        products = Products(others, anchors)
        for at in range(0, len(ids), STRIP):
            scores = products.of(anchors[at : at + STRIP])
            for i, row in enumerate(scores):
                same = np.flatnonzero((other_labels == labels[at + i]) & (other_ids != ids[at + i]))
                for j in same[first(row[same], count)]:
                    for column, value in zip(out, (ids[at + i], other_ids[j], row[j]), strict=True):
                        column.append(int(value))
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "positive_id", "positive_score"])


def best_negatives(rows: pa.Table, count: int, low: int, high: int, scale: int) -> pa.Table:
    (places, ids, labels, anchors), (other_ids, other_labels, others) = sides(rows, scale)
    out: tuple[list, ...] = ([], [], [], [], [])
    if len(ids) and len(other_ids):
        products, known = Products(others, anchors), rows.column("known")
        for at in range(0, len(ids), STRIP):
            scores = products.of(anchors[at : at + STRIP])
            for i, row in enumerate(scores):
                asked = [(p["positive_id"], p["positive_score"], *bounds(p["positive_score"], low, high)) for p in known[int(places[at + i])].as_py() or []]
                asked = [x for x in asked if x[2] <= x[3]]
                if not asked:
                    continue
                near = (row >= min(x[2] for x in asked)) & (row <= max(x[3] for x in asked)) & (other_labels != labels[at + i])
                near = np.flatnonzero(near)
                near = near[np.argsort(-row[near], kind="stable")]
                falling = -row[near]
                for positive, score, least, most in asked:
                    start = int(np.searchsorted(falling, -most, "left"))
                    end = int(np.searchsorted(falling, -least, "right"))
                    for j in near[start : min(end, start + count)]:
                        for column, value in zip(out, (ids[at + i], positive, score, other_ids[j], row[j]), strict=True):
                            column.append(int(value))
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    return pa.table([pa.array(c, pa.int64()) for c in out], names=names)


def usable(rows: DataFrame, id_column: str, label: Column, vector: str) -> DataFrame:
    """(id, label, v) of the rows that take part, one for each id."""
    base = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(~odd)
    return base.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def mine(
    rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    id_column: str = "vec_id", label: Column | None = None, vector: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """For each anchor (id divisible by ``every``) and each of its ``positives`` best rows of the same label, the ``negatives`` best
    rows of other labels whose score lies between ``low`` and ``high`` hundredths of the positive's: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. Scores are inner products of floor(scale * x); ties go to the smaller id.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Of rows that share an id the one with
    the least label, then the least vector stands. A shorter vector counts as followed by zeros. Scores beyond 64 bits count as
    the nearest long. Empty tables give no rows; further columns are ignored.

    Anchors and candidates meet in a grid of bounded groups: candidates are cut by id into groups, each anchor goes to every one
    of them, and each group keeps its own best rows, so that only those are merged. The grid is passed twice, for the positives
    and, with their scores known, for the negatives.
    """
    own = stage(usable(rows, id_column, F.col("label") if label is None else label, vector))
    asks = F.col("id") % every == 0
    count, asked = own.agg(F.count(F.lit(1)), F.count(F.when(asks, 1))).first()
    down, across = max(1, -(-asked // ANCHORS)), max(1, -(-count // CANDIDATES))

    def part(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    known_type = "array<struct<positive_id:bigint,positive_score:bigint>>"
    none = F.lit(None).cast(known_type).alias("known")
    others = own.select("id", "label", "v", F.lit(False).alias("asks"), none, part(across, 1).alias("c")).withColumn("a", all_of(down))

    def grid(anchors: DataFrame):
        spread = anchors.select("id", "label", "v", F.lit(True).alias("asks"), "known", part(down, 2).alias("a")).withColumn("c", all_of(across))
        return others.unionByName(spread).groupBy("a", "c")

    anchors = own.where(asks)
    found = grid(anchors.withColumn("known", F.lit(None).cast(known_type))).applyInArrow(
        lambda table: best_positives(table, positives, scale), "anchor_id long, positive_id long, positive_score long"
    )
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = stage(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"))
    known = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("known"))
    found = grid(anchors.join(known, "id")).applyInArrow(
        lambda table: best_negatives(table, negatives, low, high, scale),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def shifted_label() -> Column:
    """The registered query moves the label of every row whose id is divisible by seven to the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


MINE_SQL = f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
), n AS (
    SELECT p.*, other_id AS negative_id, score AS negative_score,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    WHERE {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
