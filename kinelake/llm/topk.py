"""Exact top-k by Hamming distance: incremental multi-index hashing over binary codes, in a grid of bounded groups."""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import stage

K = 10
#: A radius with more masks than this, or than a segment has buckets, is not listed: the buckets themselves are walked.
MAX_MASKS = 20_000
#: Bits of a code in one column.
WORD_BITS = 32
#: Words of codes and query codes of one group of the grid; a group is one call of the search, so these bound its memory.
CODE_WORDS, QUERIES = 1 << 21, 1 << 15
#: Smaller inputs are cut too: either side into so many parts at most, of so many codes or query codes at least.
SPREAD, LEAST_CODES, LEAST_QUERIES = 4, 1 << 17, 1 << 10
#: Queries searched together, probes and candidates held at a time.
BATCH, PROBES, CANDIDATES = 256, 1 << 16, 1 << 16


def segment_bits(codes: int) -> int:
    """Bits of a segment: so many that a bucket holds about four of evenly spread codes."""
    return min(16, max(4, round(math.log2(max(codes, 2))) - 2))


def segment_places(width: int, bits: int) -> list[tuple[int, int]]:
    """First bit and length of each segment. Lengths differ by one at most: a bucket of a short rest would hold a large share of all
    codes."""
    count = -(-width // bits)
    edges = [width * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in pairwise(edges)]


def segments(embedding: Column, width: int, bits: int) -> list[Column]:
    """Sign bits (1 above zero) of an embedding as integers of ``bits`` each; short embeddings and null entries give 0 bits."""
    parts = []
    for first in range(0, width, bits):
        part = F.slice(embedding, F.lit(first + 1), F.lit(bits))
        bit = lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        value = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a * 2 + bit(x))
        parts.append(value * F.pow(F.lit(2.0), F.lit(bits) - F.size(part)).cast("long"))
    return parts


def cut(words: np.ndarray, first: int, bits: int) -> np.ndarray:
    """The values of ``bits`` bits (16 at most) from bit ``first`` of each code."""
    at, shift = divmod(first, WORD_BITS)
    pair = words[:, at].astype(np.uint64) << np.uint64(WORD_BITS)
    if at + 1 < words.shape[1]:
        pair |= words[:, at + 1].astype(np.uint64)
    return (pair >> np.uint64(2 * WORD_BITS - shift - bits) & np.uint64((1 << bits) - 1)).astype(np.uint16)


def joined(words: np.ndarray) -> np.ndarray:
    """Words of 32 bits as half as many of 64."""
    even = np.zeros((len(words), -(-words.shape[1] // 2) * 2), np.uint32)
    even[:, : words.shape[1]] = words
    return even.view(np.uint64)


def flips(bits: int) -> list[np.ndarray]:
    """Masks of ``bits`` bits by the number of bits they set."""
    every = np.arange(1 << bits, dtype=np.uint16)
    ones = np.bitwise_count(every)
    return [every[ones == n] for n in range(bits + 1)]


class Index:
    """Codes by the value of each of their segments: the codes of a bucket are one run of the places in order of that value.

    An id is replaced by its number in order of ids; the first 64 bits of the codes are kept in the order of every segment, so that
    a run is read from one place.
    """

    def __init__(self, words: np.ndarray, ids: np.ndarray, width: int):
        self.width, self.codes = width, joined(words)
        self.ids, self.numbers = np.unique(ids, return_inverse=True)
        self.places = segment_places(width, segment_bits(len(words)))
        self.masks = {bits: flips(bits) for _, bits in self.places}
        self.order, self.heads, self.starts, self.present = [], [], [], []
        for first, bits in self.places:
            values = cut(words, first, bits)
            sizes = np.bincount(values, minlength=1 << bits)
            order = np.argsort(values, kind="stable").astype(np.int32)
            self.order.append(order)
            self.heads.append(self.codes[order, 0])
            self.starts.append(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            self.present.append(np.flatnonzero(sizes).astype(np.uint16))

    def buckets(self, segment: int, values: np.ndarray, radius: int):
        """(asker, bucket) of all buckets of the segment that differ from the asker's value in ``radius`` bits, some askers at a time."""
        masks, present = self.masks[self.places[segment][1]], self.present[segment]
        if radius >= len(masks):
            return
        walk = len(masks[radius]) > min(MAX_MASKS, len(present))
        beside = present if walk else masks[radius]
        some = max(1, PROBES // len(beside))
        for at in range(0, len(values), some):
            other = values[at : at + some, None] ^ beside
            if walk:
                asker, place = np.nonzero(np.bitwise_count(other) == radius)
                yield asker + at, present[place]
            else:
                yield np.repeat(np.arange(at, at + len(other)), len(beside)), other.ravel()

    def within(self, segment: int, radius: int, own: np.ndarray, values: np.ndarray, bound: np.ndarray):
        """(asker, number of an id, distance) of the codes in those buckets that lie within the asker's bound, some at a time."""
        starts, order, heads = self.starts[segment], self.order[segment], self.heads[segment]
        for asker, bucket in self.buckets(segment, values, radius):
            first = starts[bucket]
            sizes = starts[bucket.astype(np.int32) + 1] - first
            held = np.flatnonzero(sizes)
            asker, first, sizes = asker[held], first[held], sizes[held]
            ends = np.cumsum(sizes, dtype=np.int64)
            turns = np.flatnonzero(np.diff(ends // CANDIDATES)) + 1
            for a, b in pairwise([0, *turns.tolist(), len(sizes)]):
                if a == b:
                    continue
                run, start, who = sizes[a:b], ends[a:b] - sizes[a:b], asker[a:b]
                at = np.repeat(first[a:b] - start, run) + np.arange(start[0], ends[b - 1])
                distance = np.bitwise_count(heads[at] ^ np.repeat(own[who, 0], run))
                near = np.flatnonzero(distance <= np.repeat(bound[who], run))
                if len(near):
                    place = order[at[near]]
                    who = who[np.searchsorted(ends[a:b], near + start[0], "right")]
                    distance = distance[near].astype(np.int64)
                    for i in range(1, own.shape[1]):
                        distance += np.bitwise_count(self.codes[place, i] ^ own[who, i])
                    kept = distance <= bound[who]
                    yield who[kept], self.numbers[place[kept]], distance[kept]

    def least(self, asker: np.ndarray, number: np.ndarray, distance: np.ndarray, count: int) -> tuple:
        """Of each asker the ``count`` nearest ids, each at its least distance, by distance and id; and the rank of each."""
        ids, far = len(self.ids), self.width + 1
        pair, distance = np.divmod(np.sort((asker * ids + number) * far + distance), far)
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        asker, number = np.divmod(pair[new], ids)
        near, number = np.divmod(np.sort((asker * far + distance[new]) * ids + number), ids)
        asker, distance = np.divmod(near, far)
        rank = np.arange(len(asker)) - np.searchsorted(asker, asker)
        kept = rank < count
        return asker[kept], number[kept], distance[kept], rank[kept]

    def nearest(self, words: np.ndarray, count: int) -> tuple:
        """(asker, id, distance) of the ``count`` nearest ids of each code asked.

        The radius grows by one, segment by segment. A code that no segment has shown yet differs by more than the radius in
        those already searched with it and by the radius at least in the others; an asker whose bound is below their sum is finished.
        """
        own, values = joined(words), [cut(words, *place) for place in self.places]
        bound, none = np.full(len(words), self.width, np.int32), np.zeros(0, np.int64)
        open_, best = np.arange(len(words)), (none, none, none)
        for radius in range(max(bits for _, bits in self.places) + 1):
            for segment in range(len(self.places)):
                open_ = open_[bound[open_] >= len(self.places) * radius + segment]
                if not len(open_):
                    break
                for who, *added in self.within(segment, radius, own[open_], values[segment][open_], bound[open_]):
                    asker = open_[who]
                    met = np.zeros(len(words), bool)
                    met[asker] = True
                    again = met[best[0]]
                    both = [np.concatenate([x[again], y]) for x, y in zip(best, (asker, *added), strict=True)]
                    *merged, rank = self.least(*both, count)
                    best = tuple(np.concatenate([x[~again], y]) for x, y in zip(best, merged, strict=True))
                    full = rank == count - 1
                    bound[merged[0][full]] = merged[2][full]
        return best[0], self.ids[best[1]], best[2]


def search(rows: pa.Table, names: list[str], width: int, count: int) -> pa.Table:
    """The ``count`` nearest ids of each query code of one group of the grid, among the codes of that group."""
    asks = rows.column("asks").to_numpy(zero_copy_only=False)
    words = np.stack([rows.column(n).to_numpy().astype(np.uint32) for n in names], axis=1)
    ids = rows.column("id").fill_null(0).to_numpy()
    asked, index = words[asks], None
    out: list[pa.Table] = []
    if len(asked) and not asks.all():
        index = Index(words[~asks], ids[~asks], width)
    for at in range(0, len(asked) if index else 0, BATCH):
        some = asked[at : at + BATCH]
        asker, found, distance = index.nearest(some, count)
        columns = [pa.array(some[asker, i].astype(np.int64)) for i in range(len(names))]
        out.append(pa.table([*columns, pa.array(found), pa.array(distance.astype(np.int32))], names=[*names, "vec_id", "distance"]))
    if not out:
        none = [pa.array([], pa.int64())] * (len(names) + 1)
        return pa.table([*none, pa.array([], pa.int32())], names=[*names, "vec_id", "distance"])
    return pa.concat_tables(out)


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of each query row by Hamming distance of sign codes: query_id, rank, vec_id, distance.

    Ties go to the smaller id; the query's own id is left out. Null embeddings neither search nor are found, rows with a null
    id are not found; repeated ids count once, at the least distance of their codes. Fewer than ``k`` other rows give all of them.
    Empty tables give no rows; further columns are ignored.

    Of the rows that share a code the ``k + 1`` smallest ids stand, so a code of very many rows costs few candidates. Codes and
    distinct query codes meet in a grid of bounded groups; each group indexes its codes by segments and grows the search radius
    until the k-th distance is covered, and only its nearest ids are merged. Every join is a shuffle: query rows grow with the input.
    """
    def usable(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(
            F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")
        )

    own = usable(rows)
    width, count = own.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if not width:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    names = [f"c{i}" for i in range(-(-width // WORD_BITS))]
    coded = lambda df: df.select("id", *[c.alias(n) for n, c in zip(names, segments(F.col("v"), width, WORD_BITS), strict=True)])

    smallest = Window.partitionBy(*names).orderBy("id")
    table = coded(own).withColumn("place", F.dense_rank().over(smallest)).where(F.col("place") <= k + 1).select(*names, "id").distinct()
    asked = stage(coded(usable(queries)).distinct())
    wanted = asked.select(*names).distinct()
    parts = lambda total, most, least: max(-(-total // most), min(SPREAD, -(-total // least)), 1)
    across, down = parts(count, max(1, CODE_WORDS // len(names)), LEAST_CODES), parts(wanted.count(), QUERIES, LEAST_QUERIES)

    def part(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(*names, "id", F.lit(seed)), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    codes = table.withColumns({"asks": F.lit(False), "c": part(across, 1)}).withColumn("a", all_of(down))
    spread = wanted.withColumns({"id": F.lit(None).cast("long"), "asks": F.lit(True)}).withColumn("a", part(down, 2)).withColumn("c", all_of(across))
    kinds = "".join(f"{n} long, " for n in names)
    found = (
        codes.unionByName(spread).repartition(down * across, "a", "c").groupBy("a", "c")
        .applyInArrow(lambda group: search(group, names, width, k + 1), f"{kinds}vec_id long, distance int")
    )
    by_code = Window.partitionBy(*names).orderBy("distance", "vec_id")
    best = (
        found.repartition(*names).groupBy(*names, "vec_id").agg(F.min("distance").alias("distance"))
        .withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= k + 1)
    )
    by_query = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (
        best.join(asked.withColumnRenamed("id", "query_id").hint("merge"), names)
        .where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
        .withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "distance")
    )


NEAREST_SQL = f"""
WITH v AS (
    SELECT vec_id, CAST(array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding], '') AS BIT) AS b
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), p AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(bit_count(xor(q.b, v.b)) AS INTEGER) AS distance
    FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= {K}
"""
