"""Near duplicates by b-bit MinHash: bands propose, packed low bits estimate, full shingle sets confirm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import stage

#: 32 bands of four minima: a pair at similarity 0.8 shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Low bits kept of each minimum, packed into longs.
BITS = 2
PACKED = HASHES * BITS // 64
#: What the estimate may lack against the threshold: five standard deviations of 128 two-bit agreements at 0.8.
MARGIN = 0.21
#: Bits of the parity sketch: each shingle flips one, so two sketches differ in at most as many bits as the sets in shingles.
PARITY = 1024
SEED = 4
KNOWN_WORDS = 1 << 19

SKETCH = [*[f"s{i}" for i in range(PACKED)], *[f"p{i}" for i in range(PARITY // 64)]]
SIGNATURES = "doc_id long, n_shingles long, set_key string, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; bytes.lower and bytes.split know ASCII only, as the definition wants."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n, total = len(words) - size + 1, np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total = mixed(total + hashes[i : i + n] + np.uint64(i + 1))
    return np.unique(total)


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    masks = rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
    factors = (rng.integers(0, 1 << 31, HASHES, np.uint64) * 2 + 1).astype(np.uint32)
    return masks, factors, rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least value of each of the hash functions (32-bit bijections of the folded shingle hash)."""
    folded, least = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 1024):
        values = folded[at : at + 1024, None] ^ masks
        values *= factors
        np.minimum(least, values.min(axis=0), out=least)
    return least


def packed_bits(least: np.ndarray) -> np.ndarray:
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), PACKED, 64 // BITS)
    return np.bitwise_or.reduce(low << np.arange(0, 64, BITS, dtype=np.uint64), axis=2)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per row: number of distinct shingles, digest of their set, band keys and packed low bits (null without words)."""

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (masks, factors, salts) = WordHashes(), _constants()
        for part in parts:
            sizes, keys, rows, odd = [], [], [], []
            for text in part.column(1):
                shingles = shingle_set(text.as_py(), size, known)
                sizes.append(len(shingles))
                odd.append(parity_bits(shingles))
                keys.append(xxhash.xxh3_128_hexdigest(shingles.tobytes()) if len(shingles) else None)
                rows.append(minima(shingles, masks, factors) if len(shingles) else np.zeros(HASHES, np.uint32))
            least = np.array(rows, np.uint32).reshape(len(rows), HASHES)
            bands = mixed((least.reshape(-1, BANDS, ROWS).astype(np.uint64) * salts).sum(axis=2, dtype=np.uint64)).view(np.int64)
            bits = np.concatenate([packed_bits(least).view(np.int64), np.array(odd, np.int64).reshape(len(rows), -1)], axis=1)
            ends = pa.array(np.arange(0, len(rows) * BANDS + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()),
                 pa.ListArray.from_arrays(ends, pa.array(bands.ravel())), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(bits.shape[1])]],
                names=[f.split()[0] for f in SIGNATURES.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(sign, SIGNATURES)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of whole texts."""

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in parts:
            sets = [shingle_set(text.as_py(), size, known) for text in part.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "shingles"]
            )

    return docs.mapInArrow(gather, "node long, shingles array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from equal low bits: agreement by chance (one in 2^b) is taken out."""
    equal = []
    for i in range(PACKED):
        differing = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        either = differing.bitwiseOR(F.shiftrightunsigned(differing, 1)).bitwiseAND(F.lit(0x5555555555555555))
        equal.append(F.lit(64 // BITS) - F.bit_count(either))
    chance = 0.5**BITS
    return (reduce(lambda x, y: x + y, equal) / F.lit(float(HASHES)) - chance) / (1 - chance)


def differing(a: str, b: str) -> Column:
    """At most the number of shingles in which two sets differ, and nearly it where that is well below the sketch's bits."""
    return reduce(
        lambda x, y: x + y, [F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(PARITY // 64)]
    )


def likely(a: str, b: str, percent: int) -> Column:
    """Sizes and parities as the threshold demands them (no link fails these), and the estimate within its margin."""
    few, many = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    near = (100 + percent) * differing(a, b) <= (100 - percent) * (few + many)
    return (100 * few >= percent * many) & near & (estimate(a, b) >= percent / 100 - MARGIN)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root being the least node reachable.

    Large-star and small-star rounds: each links the neighbours of a node to their least one. Minima are partial aggregates
    and the joins on a node may be split, so that a node with very many links is no single task's work. The links of each
    round are a written table; the loop ends when a round leaves them as they were.
    """

    def least(links: DataFrame) -> DataFrame:
        return links.groupBy("u").agg(F.min("v").alias("m"))

    def seen(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    links = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = seen(links)
    while state[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(least(both), "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        )
        low = least(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = seen(links)
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet the threshold."""
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    )
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return (
        both.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b")).alias("total"))
        .where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b").distinct()
    )


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable over links) and kept.

    Rows with equal sets are one class, named by its least doc_id; only class representatives are compared. In every band
    each member of a bucket is tested against the bucket's least one, which is linear in the bucket. Pairs inside one
    component need no test. Where a bucket then still holds several components, each member outside its largest one is compared
    with the members of the others by sketch, inside the join, so that hardly more than the links themselves come out of it. No
    link that joins two components is lost. That step grows with the members outside times the bucket.

    Null and empty texts have no shingles and are linked with nothing. A row without doc_id is linked with nothing, has a
    null component_id and is kept. Rows that repeat a doc_id count as one document, linked through either text.
    """
    signed = stage(signatures(docs, size))
    full = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = stage(signed.where(full).groupBy("set_key").agg(F.min("doc_id").alias("node")))
    reps = stage(
        signed.where(full).join(classes, (signed["set_key"] == classes["set_key"]) & (signed["doc_id"] == classes["node"]))
        .select("node", "n_shingles", "bands", *SKETCH)
    )
    lean = reps.drop("bands")
    banded = reps.select(F.explode("bands").alias("band"), "node")

    def estimated(pairs: DataFrame) -> DataFrame:
        a, b = lean.alias("x"), lean.alias("y")
        return pairs.join(a, F.col("a") == F.col("x.node")).join(
            b, (F.col("b") == F.col("y.node")) & likely("x", "y", percent)
        ).select("a", "b")

    # A bucket of one node proposes nothing; the others are few, and all later steps start from them.
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail").drop("tail")
    shared = stage(banded.join(heads, "band"))
    stars = stage(estimated(shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()))

    # Sets are gathered for all nodes that share a band; the texts are read once for that.
    wanted = shared.select("node").distinct()
    sets = stage(
        shingle_sets(
            docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node", "left_semi").select("node", "text"),
            size,
        ).where(F.size("shingles") > 0)
    )
    # A doc_id that stands for several sets joins their classes.
    ids = signed.where(full).groupBy("doc_id").agg(F.min("set_key").alias("k0"), F.max("set_key").alias("k1")).where("k0 < k1")
    again = signed.where(full).join(ids, "doc_id").select("set_key", "k0")
    same = again.join(classes, "set_key").select("k0", F.col("node").alias("b")).join(
        classes.select(F.col("set_key").alias("k0"), F.col("node").alias("a")), "k0"
    )
    edges = stage(confirm(stars, sets, percent).union(same.select("a", "b")))
    roots = components(edges)
    placed = shared.select("band", "node", "head").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Members per component and bucket; the largest component of a bucket is its main one.
    weights = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("members"))
    mains = weights.groupBy("band").agg(
        F.max(F.struct("members", "root")).getField("root").alias("main"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1").drop("parts")
    open_ = stage(placed.join(mains, "band").join(lean, "node"))
    x, y = open_.where("root <> main").alias("x"), open_.alias("y")
    # Both aside: once is enough. Pairs with the head of a bucket have been tested at the start.
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("x.node") != F.col("x.head")) & (F.col("y.node") != F.col("y.head"))
    found = x.join(y, (F.col("x.band") == F.col("y.band")) & apart & once & likely("x", "y", percent)).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    ).distinct()
    more = stage(confirm(found, sets, percent))
    if not more.isEmpty():
        # What is linked already goes on as one link from each node to its root.
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    placed = classes.join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    own = signed.select("doc_id", "n_shingles", "set_key")
    grouped = own.where(full).join(placed, "set_key").select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    alone = own.where(~full).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    named = grouped.union(alone)
    return named.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def drop_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each group the one with the least doc_id stays, with unchanged columns.

    Of rows that repeat a doc_id one stays; rows without doc_id all stay.
    """
    from pyspark.sql import Window

    kept = near_duplicates(docs, size, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    first = Window.partitionBy("__id").orderBy(F.xxhash64("text"), "text")
    known = (
        docs.withColumn("__id", F.col("doc_id").cast("long")).join(kept, "__id", "left_semi")
        .withColumn("__place", F.row_number().over(first)).where("__place = 1")
    )
    return known.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))
