"""Near duplicates among embeddings: a subspace pigeonhole join, links counted inside bounded groups, components over them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import stage
from kinelake.llm.dedup import components

COSINE = 0.98
#: Dimensions of a block.
BLOCK = 8
#: Vectors of a cell that one group holds at most, about; larger cells are cut into parts that meet pair by pair.
CELL = 2048
#: Slack for rounding, in squared distance of unit vectors. It only adds candidates, which are verified.
SLACK = 1e-9
STRIP, PAIRS = 64, 1 << 16
SEED = 13


def unit(vectors: np.ndarray) -> np.ndarray:
    """Columns of length one from rows; element-wise only, so a vector gives the same bits in every group."""
    x = np.ascontiguousarray(vectors.T, np.float64)
    x = x / np.abs(x).max(axis=0)
    total = np.zeros(x.shape[1])
    for row in x:
        total += row * row
    return x / np.sqrt(total)


def turned(x: np.ndarray) -> np.ndarray:
    """The unit columns rotated: three rounds of seeded signs and a Hadamard transform, which spreads every vector evenly over all
    coordinates. Padded with zeros to a power of two; element-wise too."""
    size = 1 << max(0, x.shape[0] - 1).bit_length()
    y = np.zeros((size, x.shape[1]))
    y[: x.shape[0]] = x
    signs = np.random.default_rng([SEED, size]).integers(0, 2, (3, size)) * 2.0 - 1.0
    for sign in signs:
        y *= sign[:, None]
        half = 1
        while half < size:
            z = y.reshape(size // (2 * half), 2, half, -1)
            y = np.stack([z[:, 0] + z[:, 1], z[:, 0] - z[:, 1]], axis=1).reshape(size, -1)
            half *= 2
        y *= size**-0.5
    return y


def blocks(size: int) -> list[tuple[int, int]]:
    return [(at, min(at + BLOCK, size)) for at in range(0, size, BLOCK)]


def budgets(size: int, cosine: float) -> list[float]:
    """Squared distance that each block may show, in proportion to its dimensions: unit vectors at the threshold differ by
    2 - 2 * cosine in all, so at least one block stays within its share."""
    return [(2 - 2 * cosine + SLACK) * (end - at) / size for at, end in blocks(size)]


def cells(y: np.ndarray, budget: float, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cell, home) of a block: each row's own cell, then the smaller cells that a partner within the budget may own.

    Cells are wider than twice the radius, so a row is near one side of its cell at most in each gridded dimension.
    """
    radius = math.sqrt(budget) + SLACK
    width = 2 * radius + 4 * SLACK
    bits = max(2, math.ceil(math.log2(2 / width + 2)) + 1)
    grid = max(1, min(grid, len(y), 62 // bits))
    place = np.floor(y[:grid] / width).astype(np.int64)
    shift = [bits * i for i in range(grid)]
    code = sum((place[i] + (1 << (bits - 1))) << shift[i] for i in range(grid))
    every = np.arange(y.shape[1])
    yield every, code, True
    inside = y[:grid] - place * width
    low = inside <= width - inside
    gap = np.where(low, inside, width - inside)
    step = np.where(low, -1, 1)
    for mask in range(1, 1 << grid):
        chosen = [i for i in range(grid) if mask >> i & 1]
        near = sum(np.maximum(gap[i], 0) ** 2 for i in chosen) <= radius * radius
        other = code + sum(step[i] << shift[i] for i in chosen)
        near &= other < code
        if near.any():
            yield every[near], other[near], False


PLACED = "label long, size int, block int, cell long, home boolean, node long, weight long"


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def placed(reps: DataFrame, cosine: float, grid: int, vectors: bool) -> DataFrame:
    """One row per vector, block and cell in which it may meet a partner; with the vector itself where asked for."""

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lengths = pc.list_value_length(part.column("v")).to_numpy()
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                some = max(64, (1 << 22) // (8 * length))
                for at in range(0, len(rows), some):
                    chunk = part.take(pa.array(rows[at : at + some]))
                    y = turned(unit(matrix(chunk.column("v"), length)))
                    for block, ((start, end), budget) in enumerate(zip(blocks(len(y)), budgets(len(y), cosine), strict=True)):
                        for own, cell, home in cells(y[start:end], budget, grid):
                            n = len(own)
                            taken = chunk.take(pa.array(own))
                            out = [
                                taken.column("label"), pa.array(np.full(n, length, np.int32)), pa.array(np.full(n, block, np.int32)),
                                pa.array(cell), pa.array(np.full(n, home)), taken.column("node"), taken.column("weight"),
                            ]
                            names = [f.split()[0] for f in PLACED.split(", ")]
                            if vectors:
                                out, names = [*out, taken.column("v")], [*names, "v"]
                            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = dict(reps.dtypes)["v"]
    return reps.select("label", "node", "weight", "v").mapInArrow(place, PLACED + (f", v {kind}" if vectors else ""))


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of linked rows; a class is named by its least row."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (root[root] != root).any():
            root[:] = root[root]


def linked(rows: pa.Table, block: int, cosine: float, own_pairs: bool) -> pa.Table:
    """Of one group: for each row with links, the weight of those found here, and the least row of its class here.

    A pair may meet in several blocks; it counts in the first one whose budget it keeps, and there in one group only.
    """
    target = np.flatnonzero(rows.column("target").to_numpy(zero_copy_only=False))
    guest = np.flatnonzero(~rows.column("target").to_numpy(zero_copy_only=False))
    order = np.concatenate([target, guest])
    rows = rows.take(pa.array(order)).combine_chunks()
    node, weight, n, most = rows.column("node").to_numpy(), rows.column("weight").to_numpy(), len(order), len(target)
    vectors = rows.column("v").combine_chunks()
    length = len(vectors[0])
    x = unit(matrix(vectors, length))
    y = turned(x)
    spans, limits = blocks(len(y)), budgets(len(y), cosine)
    at, to = spans[block]
    part = y[at:to]
    squares = (part * part).sum(axis=0)
    links, root = np.zeros(n, np.int64), np.arange(n)

    def distance(b: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = np.zeros(len(i))
        for k in range(*spans[b]):
            gap = y[k, i] - y[k, j]
            total += gap * gap
        return total

    for start in range(0, most, STRIP):
        end = min(start + STRIP, most)
        first = start if own_pairs else most
        if first == n:
            continue
        close = squares[start:end, None] + squares[None, first:] - 2 * (part[:, start:end].T @ part[:, first:]) <= limits[block] + SLACK
        left, right = np.nonzero(close)
        left, right = left + start, right + first
        keep = left < right
        left, right = left[keep], right[keep]
        for p in range(0, len(left), PAIRS):
            i, j = left[p : p + PAIRS], right[p : p + PAIRS]
            cos = np.zeros(len(i))
            for row in x:
                cos += row[i] * row[j]
            keep = cos >= cosine
            i, j = i[keep], j[keep]
            keep = distance(block, i, j) <= limits[block]
            for b in range(block):
                if keep.any():
                    keep &= distance(b, i, j) > limits[b]
            i, j = i[keep], j[keep]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            unite(root, i, j)
    found = np.flatnonzero(links)
    return pa.table({"node": node[found], "links": links[found], "head": node[root[found]]})


def near_vectors(
    rows: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links (other vectors of the same label at ``cosine`` or more), component_id (least id
    reachable over links, its own included) and kept (vec_id = component_id).

    Vectors that are null, zero, empty or hold a null or non-finite component, and rows with a null label or id, link with nothing,
    nor do vectors of different lengths; a null id keeps its row with a null component_id, and kept is true. Equal vectors of a label are linked. Rows
    that share an id are vectors of their own for the count and one member of the components. An empty table gives no rows;
    further columns are ignored.

    Equal vectors are one entry with a weight. Rotated vectors are cut into blocks of ``BLOCK`` dimensions; each block is joined
    over a grid of cells as wide as twice its share of the distance, in as many dimensions as the number of vectors asks for. A
    cell beyond ``CELL`` vectors is cut into parts that meet pair by pair, so no group grows with the data. Groups return counts
    and one link per row to the least row of its class there, never pairs.
    """
    kind = dict(rows.dtypes)[vector]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    base = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast(kind).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    taking = base.where(sound)
    reps = taking.groupBy("label", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    reps = stage(reps.withColumn("node", F.monotonically_increasing_id()))
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    grid = max(1, math.ceil(math.log(max(1.0, largest / CELL), 3)))

    key = ["label", "size", "block", "cell"]
    sizes = placed(reps, cosine, grid, False).groupBy(*key).agg(F.count(F.lit(1)).alias("held"))
    crowded = stage(sizes.where(F.col("held") > CELL).select(*key, F.ceil(F.col("held") / CELL).cast("int").alias("parts")))
    here = placed(reps, cosine, grid, True).join(crowded, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    here = here.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def meets(row: Column, column: Column, target: bool) -> Column:
        return F.struct(row.alias("x"), column.alias("y"), F.lit(target).alias("target"))

    mine, last = F.col("mine"), F.col("parts") - 1
    # Part x of a cell's own vectors meets part y of all that come to it; of its own ones each pair of parts once.
    as_target = F.transform(F.sequence(F.lit(0), last), lambda y: meets(mine, y, True))
    as_later = F.when(mine > 0, F.transform(F.sequence(F.lit(0), F.greatest(mine - 1, F.lit(0))), lambda x: meets(x, mine, False)))
    as_guest = F.transform(F.sequence(F.lit(0), last), lambda x: meets(x, mine, False))
    roles = F.when(F.col("home"), F.concat(as_target, F.coalesce(as_later, F.slice(as_target, 1, 0)))).otherwise(as_guest)
    met = here.withColumn("m", F.explode(roles)).select("label", "size", "block", "cell", "m.x", "m.y", "m.target", "node", "weight", "v")

    def group(keys: tuple, table: pa.Table) -> pa.Table:
        _, _, block, _, x, y = (k.as_py() for k in keys)
        return linked(table, block, cosine, x == y)

    found = stage(met.groupBy("label", "size", "block", "cell", "x", "y").applyInArrow(group, "node long, links long, head long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))

    # Which entry a row belongs to; rows that share an id join their entries.
    of_row = taking.join(reps.select("label", "v", "node", "weight"), ["label", "v"]).select("vec_id", "node", "weight")
    of_row = stage(of_row)
    shared = of_row.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    edges = found.select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b")
    edges = edges.union(of_row.join(shared, "vec_id").where("node <> a").select("a", F.col("node").alias("b")))
    roots = components(edges)
    least = (
        roots.join(reps.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
        .join(roots, "root").select("node", "component_id")
    )
    entry = (
        reps.select("node", "least").join(counts, "node", "left").join(least, "node", "left")
        .select("node", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    given = of_row.join(entry, "node").select("vec_id", (F.col("weight") - 1 + F.col("links")).alias("n_links"), "component_id")
    # A row that takes no part may still share its id with one that does.
    ids = given.groupBy("vec_id").agg(F.min("component_id").alias("c"))
    rest = base.where(~F.coalesce(sound, F.lit(False))).select("vec_id").join(ids, "vec_id", "left")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    out = given.union(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


NEAR_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0
), pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION SELECT reach.vec_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other
), c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN c ON c.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id
"""
