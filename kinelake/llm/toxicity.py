"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import fold, stage

PARTS, HELD_OUT = 5, 0
#: The classifier is fitted on at most so many labelled documents, taken by hash of their id; the whole texts count.
EXAMPLES = 20_000
#: Every word of the examples counts. Its inverse document frequency is multiplied by FLOOR plus its log odds between the classes,
#: shrunk twice: counts by so many pseudo-examples at the overall rate, the odds by so many times their own variance.
FLOOR, PSEUDO, SHRINK = 0.01, 10.0, 25.0
NEIGHBOURS, BLOCK = 15, 256
#: So many of the most frequent words are kept as a dense matrix; texts are searched in batches; slack for single precision.
DENSE, BATCH, SLACK = 512, 128, 1e-4
#: Weight of the overall rate against the neighbours' votes, and least distance of a neighbour.
PRIOR, NEAR = 0.5, 0.05
EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SEED = 8
KNOWN_TERMS = 1 << 19

VECTORS = "doc_id long, held_out boolean, terms array<int>, counts array<int>"
SCORES = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>"


def folded(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words_of(text: str | None) -> list[bytes]:
    return [w.strip(EDGES) for w in folded(text)]


def example_labels(labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic) of the training examples: none held out, at most ``most``. Repeated labels count as their largest."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), PARTS) != HELD_OUT))
    single = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return single.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most)


def term_counts(examples: DataFrame) -> DataFrame:
    """(term, n, toxic): examples with the term, and toxic ones among them; added up per task first."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            pairs = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["term", "n", "toxic"]
            )

        for part in parts:
            for text, label in zip(part.column(0), part.column(1), strict=True):
                toxic = int(label.as_py() > 0)
                for word in set(words_of(text.as_py())):
                    pair = seen.setdefault(word, [0, 0])
                    pair[0] += 1
                    pair[1] += toxic
                if len(seen) > KNOWN_TERMS:
                    yield flush()
                    seen = {}
        yield flush()

    counted = examples.select("text", "toxic").mapInArrow(count, "term binary, n long, toxic long")
    return counted.where("length(term) > 0").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def class_factors(n: np.ndarray, t: np.ndarray, total: int, toxic: int) -> np.ndarray:
    """Factor of words that ``n`` examples have, ``t`` of them toxic: near FLOOR where the odds may be chance, never below it."""
    rate = toxic / total
    bad, good = t + PSEUDO * rate, n - t + PSEUDO * (1 - rate)
    square = (np.log(bad / good) - np.log(rate / (1 - rate))) ** 2
    return FLOOR + np.sqrt(square) * square / (square + SHRINK * (1 / bad + 1 / good))


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Counts of the examples' words in every whole text."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(terms)}
        for part in parts:
            found, numbers = [], []
            for text in part.column(2):
                own: dict[int, int] = {}
                for word, n in Counter(folded(text.as_py())).items():
                    i = place.get(word.strip(EDGES))
                    if i is not None:
                        own[i] = own.get(i, 0) + n
                keys = sorted(own)
                found.append(keys)
                numbers.append([own[k] for k in keys])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.int32()))],
                names=["doc_id", "held_out", "terms", "counts"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), PARTS) == HELD_OUT).alias("held_out"), "text"
    ).mapInArrow(count, VECTORS)


class BlockMaxIndex:
    """Inverted lists over the examples, cut into blocks, with the largest weight of each frequent term in each block.

    Rare terms are added up from their lists. With the block's maxima of the frequent terms that bounds every cosine in the block,
    and a block is opened if its bound reaches the k-th best cosine of the blocks opened first. Single precision picks candidates
    with slack, double precision ranks them, so the neighbours are exactly the nearest; ties go to the earlier example.
    """

    def __init__(self, rows: list[tuple[int, int, list[int], list[int]]], idf: np.ndarray):
        self.idf = np.asarray(idf, float)
        rows = sorted((r for r in rows if len(r[2])), key=lambda r: (tuple(r[2][:8]), r[0]))
        n = len(rows)
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], float)
        self.place = {i: p for p, i in enumerate(self.ids.tolist())}
        self.blocks = -(-n // BLOCK)
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = np.concatenate([np.empty(0, np.int32), *[np.asarray(r[2], np.int32) for r in rows]])
        self.weights = np.concatenate([np.empty(0), *[self.vector(r[2], r[3])[1] for r in rows]])
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        often = np.bincount(self.terms, minlength=len(self.idf))
        self.column = np.full(len(self.idf), -1, np.int32)
        common = np.argsort(-often, kind="stable")[:DENSE]
        self.column[common] = np.arange(len(common))
        own = self.column[self.terms]
        self.dense = np.zeros((self.blocks * BLOCK, len(common)), np.float32)
        self.dense[owner[own >= 0], own[own >= 0]] = self.weights[own >= 0]
        self.most = self.dense.reshape(self.blocks, BLOCK, len(common)).max(axis=1)
        rare = np.flatnonzero(own < 0)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.places, self.listed = owner[rare], self.weights[rare].astype(np.float32)
        self.lists = np.concatenate([[0], np.cumsum(np.where(self.column < 0, often, 0))])

    def vector(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        terms = np.asarray(terms, np.int64)
        weights = (1 + np.log(np.asarray(counts, float))) * self.idf[terms]
        return terms, weights / (np.linalg.norm(weights) or 1)

    def nearest(self, terms, counts, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples that share a term, ``without`` one place."""
        return self.nearest_of([(terms, counts, without)], k)[0]

    def nearest_of(self, texts: list[tuple], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for a batch of (terms, counts, without)."""
        if not self.blocks:
            return [(np.empty(0, np.int64), np.empty(0)) for _ in texts]
        queries = [self.vector(t, c) for t, c, _ in texts]
        common = np.zeros((len(texts), self.dense.shape[1]), np.float32)
        scores = np.zeros((len(texts), self.blocks * BLOCK), np.float32)
        for i, (terms, weights) in enumerate(queries):
            own = self.column[terms]
            common[i, own[own >= 0]] = weights[own >= 0]
            terms, weights = terms[own < 0], weights[own < 0]
            heads, sizes = self.lists[terms], self.lists[terms + 1] - self.lists[terms]
            entry = np.arange(sizes.sum()) + np.repeat(heads - (np.cumsum(sizes) - sizes), sizes)
            scores[i] = np.bincount(self.places[entry], self.listed[entry] * np.repeat(weights, sizes), scores.shape[1])
        cells = scores.reshape(len(texts), self.blocks, BLOCK)
        bounds = common @ self.most.T + cells.max(axis=2)
        opened = np.zeros(bounds.shape, bool)

        def open_blocks(wanted: np.ndarray) -> None:
            for j in np.flatnonzero((wanted & ~opened).any(axis=0)):
                rows = np.flatnonzero(wanted[:, j] & ~opened[:, j])
                cells[rows, j] += common[rows] @ self.dense[j * BLOCK : (j + 1) * BLOCK].T
            opened[wanted] = True

        def least() -> np.ndarray:
            """The k-th best cosine of each text in what is opened; only opened blocks are looked at."""
            best = np.zeros(len(texts), np.float32)
            for i, (_, _, without) in enumerate(texts):
                rows = np.flatnonzero(opened[i])
                seen = cells[i, rows]
                if without >= 0:
                    seen[rows == without // BLOCK, without % BLOCK] = 0
                if k <= seen.size and k < scores.shape[1]:
                    best[i] = np.partition(seen.ravel(), -k)[-k]
            return best

        open_blocks(bounds >= np.partition(bounds, -min(2, self.blocks), axis=1)[:, -min(2, self.blocks), None])
        open_blocks(bounds >= least()[:, None] - SLACK)
        enough = least() - SLACK
        lookup, out = np.zeros(len(self.idf)), []
        for i, (terms, weights) in enumerate(queries):
            rows = np.flatnonzero(opened[i])
            at, within = np.nonzero((cells[i, rows] >= enough[i]) & (cells[i, rows] > 0))
            found = rows[at] * BLOCK + within
            found = found[found != texts[i][2]]
            lookup[terms] = weights
            sizes = self.starts[found + 1] - self.starts[found]
            entry = np.arange(sizes.sum()) + np.repeat(self.starts[found] - (np.cumsum(sizes) - sizes), sizes)
            values = np.bincount(np.repeat(np.arange(len(found)), sizes), lookup[self.terms[entry]] * self.weights[entry], len(found))
            lookup[terms] = 0
            best = np.lexsort((found, -np.round(values, 12)))[:k]
            out.append((found[best], values[best]))
        return out

    def vote(self, found: np.ndarray, cosines: np.ndarray, rate: float) -> float:
        weights = 1 / (NEAR + np.maximum(0.0, 1 - cosines))
        return float((weights @ self.labels[found] + PRIOR * rate) / (weights.sum() + PRIOR))


class Examples:
    """What the index is made of, as flat arrays, compressed on its way; each Python worker builds its index once."""

    def __init__(self, found: pa.Table, idf: np.ndarray):
        terms, counts = (found[c].combine_chunks() for c in ("terms", "counts"))
        self.arrays = [
            found["doc_id"].to_numpy(), (found["toxic"].to_numpy() > 0).astype(np.int8), terms.value_lengths().to_numpy(),
            terms.flatten().to_numpy(), counts.flatten().to_numpy(), idf,
        ]
        self.built: BlockMaxIndex | None = None

    def __getstate__(self):
        return [(a.dtype.str, zlib.compress(a.tobytes(), 1)) for a in self.arrays]

    def __setstate__(self, state):
        self.arrays, self.built = [np.frombuffer(zlib.decompress(b), kind) for kind, b in state], None

    def index(self) -> BlockMaxIndex:
        if self.built is None:
            ids, labels, sizes, terms, counts, idf = self.arrays
            cuts = np.cumsum(sizes)[:-1]
            rows = zip(ids.tolist(), labels.tolist(), np.split(terms, cuts), np.split(counts, cuts), strict=True) if len(ids) else []
            self.built, self.arrays = BlockMaxIndex(list(rows), idf), []
        return self.built


def calibration(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps from vote to observed rate (pool adjacent violators), smoothed by one half of either label each."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y in zip(votes[order], labels[order], strict=True):
        if pools and pools[-1][2] == v:
            pools[-1][0] += y
            pools[-1][1] += 1
        else:
            pools.append([y, 1, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y, n, v = pools.pop()
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + n, v]
    return np.array([p[2] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])


def searched(index: BlockMaxIndex, part: pa.RecordBatch, alone: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """The nearest examples of every row of (doc_id, terms, counts), ``alone`` without the row's own; equal rows are searched once."""
    ids, texts = part.column("doc_id").to_pylist(), []
    columns = [part.column(c) for c in ("terms", "counts")]
    (terms, counts), cuts = [c.flatten().to_numpy() for c in columns], np.concatenate([[0], np.cumsum(columns[0].value_lengths().to_numpy())])
    known: dict[tuple, int] = {}
    at = []
    for i, doc in enumerate(ids):
        t, c = terms[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]
        without = index.place.get(doc, -1) if alone else -1
        at.append(known.setdefault((t.tobytes(), c.tobytes(), without), len(texts)))
        if at[-1] == len(texts):
            texts.append((t, c, without))
    found = [x for i in range(0, len(texts), BATCH) for x in index.nearest_of(texts[i : i + BATCH])]
    return [found[i] for i in at]


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """One row per document: score, prediction and the nearest examples behind it.

    Labels are read for documents that are not held out only, and only words are inputs. A text without any word of the examples
    (null and empty ones too) gets the rate of examples without any; without labels every score is 0. Repeated rows are scored
    each. Document frequencies count all documents.
    """
    chosen = stage(example_labels(labels, examples))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    total, toxic = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    terms, factors = [], np.empty(0)
    if 0 < toxic < total:
        counted = term_counts(texts).toArrow()
        n, t = (counted[c].to_numpy().astype(float) for c in ("n", "toxic"))
        # Repeated rows of one example may count a word more often than there are examples.
        factors, terms = class_factors(n, np.minimum(t, n), total, toxic), counted["term"].to_pylist()
        order = sorted(range(len(terms)), key=lambda i: (-factors[i], terms[i]))
        terms, factors = [bytes(terms[i]) for i in order], factors[order]
    found = stage(vectors(docs, terms))
    n_docs = found.count()
    frequency = np.zeros(len(terms))
    seen = found.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    frequency[seen["t"].to_numpy()] = seen["count"].to_numpy()
    known = stage(found.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "toxic", "terms", "counts"))
    gathered = known.toArrow()
    classes = dict(zip(gathered["doc_id"].to_pylist(), (gathered["toxic"].to_numpy() > 0).tolist(), strict=True))
    bare = (gathered["toxic"].to_numpy() > 0)[gathered["terms"].combine_chunks().value_lengths().to_numpy() == 0]
    rate = toxic / total if total else 0.0
    plain = (bare.sum() + rate) / (len(bare) + 1)
    # One broadcast for both passes, which a worker keeps.
    shared = docs.sparkSession.sparkContext.broadcast(Examples(gathered, (np.log((1 + n_docs) / (1 + frequency)) + 1) * factors))
    del gathered, terms, frequency, seen, factors

    def vote_alone(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value.index()
        for part in parts:
            part = part.filter(pa.compute.greater(pa.compute.list_value_length(part.column("terms")), 0))
            own = [index.vote(*x, rate) for x in searched(index, part, alone=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.float64())], names=["doc_id", "vote"])

    # At most as many rows as there are examples.
    own = sorted(known.select("doc_id", "terms", "counts").mapInArrow(vote_alone, "doc_id long, vote double").collect())
    labelled = np.array([classes[r.doc_id] for r in own], float)
    steps, rates = calibration(np.array([r.vote for r in own]), labelled)

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value.index()
        for part in parts:
            scores, neighbours = [], []
            for places, cosines in searched(index, part):
                if len(places):
                    step = np.searchsorted(steps, index.vote(places, cosines, rate))
                    scores.append(float(rates[min(step, len(rates) - 1)]))
                else:
                    scores.append(float(plain))
                neighbours.append(index.ids[places])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(neighbours, pa.list_(pa.int64())),
                ],
                names=["doc_id", "held_out", "score", "predicted", "neighbours"],
            )

    return found.mapInArrow(judge, SCORES)
