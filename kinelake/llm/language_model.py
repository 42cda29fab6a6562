"""Word bigram model by deleted interpolation: bucketed mixture weights learned by expectation-maximisation."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import fold, stage

PARTS, HELD_OUT = 5, 1
#: One of so many training documents, by the hash of its text, teaches the weights and is counted for nothing else of the model.
DELETED = 10
#: Roles of a document: its n-grams are counted, it is held out of everything, or it teaches the weights.
COUNTED, APART, TEACHING = 0, 1, 2
#: Tokens tokenised into one row, and n-gram keys counted by one task.
BATCH_TOKENS, TASK_KEYS = 1 << 20, 1 << 20
#: Tokens of a batch whose probabilities are worked out at once.
SLICE = 1 << 17
END, START = 0, 1
#: Context frequencies are bucketed by powers of two; probabilities of held-out tokens by quarters of an octave.
BUCKETS, BINS, PER_OCTAVE = 33, 160, 4
ROUNDS = 60
MARKS = (xxhash.xxh3_64_intdigest(b" end"), xxhash.xxh3_64_intdigest(b" start"))

BATCHES = "batch string, doc_ids array<long>, roles array<tinyint>, lens array<int>, tokens binary, vocab binary, n_keys long"
REQUESTS = "kind int, part int, batch string, keys binary, counts binary"
REPLIES = "batch string, kind int, part int, totals binary, known long, mass long, counted long"
CELLS = "bucket int, f2 int, f1 int, n double"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(values: np.ndarray) -> bytes:
    """Numbers without sign, compressed byte by byte: high bytes are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values[:, None].view(np.uint8).T).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    """The numbers of ``packed``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind)[:, 0]


class Vocabulary(dict):
    """Indices of the words of one batch, in order of appearance after the two marks."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self) + 2
        return value


def tokenise(docs: DataFrame) -> DataFrame:
    """Batches of documents: token indices into a vocabulary of word hashes. White space never occurs in a word, so the hashes
    of the two marks (texts that start with a blank) are no word's."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in BATCHES.split(", ")]
        types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
        ids, roles, lens, tokens, known = [], [], [], [], Vocabulary()

        def flush() -> pa.RecordBatch:
            hashes = np.array([*MARKS, *map(xxhash.xxh3_64_intdigest, known)], np.uint64)
            flat = np.concatenate(tokens)
            values = [uuid.uuid4().hex, ids, roles, lens, packed(flat), hashes.tobytes(), len(hashes) + len(flat)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for part in parts:
            for i, text in enumerate(part.column(1)):
                body = (text.as_py() or "").encode("utf-8", "surrogatepass")
                words = body.lower().split()
                line = np.zeros(len(words) + 1, np.uint32)
                line[:-1] = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                ids.append(part.column(0)[i].as_py())
                # Equal texts have one role, so a text that occurs twice cannot vouch for itself.
                teaching = xxhash.xxh3_64_intdigest(body) % DELETED == 0
                roles.append(APART if part.column(2)[i].as_py() else TEACHING if teaching else COUNTED)
                lens.append(len(line))
                tokens.append(line)
                if sum_of(lens) >= BATCH_TOKENS:
                    yield flush()
                    ids, roles, lens, tokens, known = [], [], [], [], Vocabulary()
        if ids:
            yield flush()

    def sum_of(lens: list[int], state={"n": 0, "sum": 0}) -> int:  # noqa: B006
        if state["n"] != len(lens) - 1:
            state["sum"] = sum(lens[:-1])
        state["n"], state["sum"] = len(lens), state["sum"] + lens[-1]
        return state["sum"]

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), (fold(F.col("doc_id"), PARTS) == HELD_OUT).alias("held")
    ).mapInArrow(rows, BATCHES)


class Batch:
    """N-grams of one batch row: distinct keys in a fixed order, and each token's place among them."""

    def __init__(self, lens, roles, tokens: bytes, vocab: bytes):
        self.lens = np.asarray(lens, np.int64)
        self.held = np.asarray(roles, np.int8) == APART
        self.tokens = unpacked(tokens, np.uint32).astype(np.int64)
        self.hashes = np.frombuffer(vocab, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64)
        self.roles = np.repeat(np.asarray(roles, np.int8), self.lens)
        self.contexts = np.empty_like(self.tokens)
        self.contexts[1:] = self.tokens[:-1]
        self.contexts[self.starts] = START
        local, self.pair_of = np.unique(self.contexts * len(self.hashes) + self.tokens, return_inverse=True)
        a, b = self.hashes[local // len(self.hashes)], self.hashes[local % len(self.hashes)]
        pairs = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
        pairs = (pairs ^ (pairs >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        self.keys = (self.hashes, pairs ^ (pairs >> np.uint64(31)))
        self.orders = tuple(np.argsort(k, kind="stable") for k in self.keys)

    def counts(self, kind: int) -> list[np.ndarray]:
        """Counts that the model is made of, in counted documents; before them, for single words, those in all training documents."""
        places, which = self.pair_of if kind else self.tokens, [self.roles == COUNTED]
        if not kind:
            which.insert(0, self.roles != APART)
        return [np.bincount(places[w], minlength=len(self.keys[kind])) for w in which]

    def cuts(self, kind: int, parts: int) -> np.ndarray:
        """Where each part's stretch of the ordered keys begins and ends: parts are equal ranges of the key."""
        edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
        inner = np.searchsorted(self.keys[kind][self.orders[kind]], edges)
        return np.concatenate([[0], inner, [len(self.keys[kind])]])


def requests(batches: DataFrame, parts: int) -> DataFrame:
    """The distinct n-grams of each batch with their training counts, cut by key range."""

    def asked(row) -> pd.DataFrame:
        # A function of its own, so that the arrays of one batch are gone before the next one's are made.
        batch, out = Batch(row.lens, row.roles, row.tokens, row.vocab), []
        for kind in (0, 1):
            keys = batch.keys[kind][batch.orders[kind]]
            counts = np.stack(batch.counts(kind))[:, batch.orders[kind]].astype(np.uint32)
            cuts = batch.cuts(kind, parts)
            out += [
                (kind, p, row.batch, packed(np.diff(keys[i:j], prepend=np.uint64(0))), packed(counts[:, i:j].ravel()))
                for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i
            ]
        return pd.DataFrame(out, columns=[f.split()[0] for f in REQUESTS.split(", ")])

    def rows(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for row in table.itertuples(index=False):
                yield asked(row)

    return batches.select("batch", "roles", "lens", "tokens", "vocab").mapInPandas(rows, REQUESTS)


def add_up(part: pd.DataFrame) -> pd.DataFrame:
    """Totals of one range of keys, handed back to every batch in the order in which it asked."""
    asked = [np.cumsum(unpacked(k, np.uint64), dtype=np.uint64) for k in part["keys"]]
    sizes, keys = [len(k) for k in asked], np.concatenate(asked)
    given = [unpacked(c, np.uint32).reshape(-1, n) for c, n in zip(part["counts"], sizes, strict=True)]
    distinct, place = np.unique(keys, return_inverse=True)
    totals = np.stack([np.bincount(place, weights=c, minlength=len(distinct)) for c in np.concatenate(given, axis=1)]).astype(np.uint64)
    answers = [packed(x.ravel()) for x in np.split(totals[:, place], np.cumsum(sizes)[:-1], axis=1)]
    first = np.arange(len(part)) == 0
    return pd.DataFrame({
        "batch": part["batch"], "kind": part["kind"], "part": part["part"], "totals": answers,
        "known": np.where(first, int((totals[0] > 0).sum()), 0), "mass": np.where(first, int(totals[0].sum()), 0),
        "counted": np.where(first, int(totals[-1].sum()), 0),
    })


def _answered(row) -> tuple[Batch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch with the corpus counts of each token: in all training documents, and in the counted ones, where also those of its
    context and of the pair of both."""
    batch, columns = Batch(row.lens, row.roles, row.tokens, row.vocab), []
    for kind in (0, 1):
        parts = [t for _, t in sorted((a["part"], a["totals"]) for a in row.answers if a["kind"] == kind)]
        ordered = np.concatenate([unpacked(t, np.uint64).reshape(2 - kind, -1) for t in parts], axis=1)
        back = np.empty(ordered.shape, np.uint64)
        back[:, batch.orders[kind]] = ordered
        columns += list(back.view(np.int64))
    trained, single, double = columns
    single[START] = single[END]  # a document starts as often as it ends
    return batch, trained[batch.tokens], single[batch.tokens], single[batch.contexts], double[batch.pair_of]


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def _bin(p: np.ndarray) -> np.ndarray:
    """0: impossible; else one more than the quarter octaves below 1."""
    return np.where(p > 0, np.minimum(np.rint(-PER_OCTAVE * np.log2(np.maximum(p, 1e-300))).astype(np.int64) + 1, BINS - 1), 0)


def held_out_cells(answered: DataFrame, counted: int) -> DataFrame:
    """Tokens of the teaching documents, by context bucket and by what bigram and unigram of the counted documents give them."""

    def places(row) -> np.ndarray:
        batch, _, c2, c1, c12 = _answered(row)
        c2, c1, c12 = (x[batch.roles == TEACHING] for x in (c2, c1, c12))
        return (_bucket(c1) * BINS + _bin(c12 / np.maximum(c1, 1))) * BINS + _bin(c2 / max(counted, 1))

    def rows(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(BUCKETS * BINS * BINS)
        for table in tables:
            for row in table.itertuples(index=False):
                cells += np.bincount(places(row), minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pd.DataFrame({"bucket": at // (BINS * BINS), "f2": at // BINS % BINS, "f1": at % BINS, "n": cells[at]})

    return answered.mapInPandas(rows, CELLS).groupBy("bucket", "f2", "f1").agg(F.sum("n").alias("n"))


def learn_weights(cells: pd.DataFrame, kinds: int) -> np.ndarray:
    """Weights of bigram, unigram and uniform share for each bucket. A bucket that no teaching token has takes those of the
    next lower one; without any, all weight is on the uniform share. The bigram share of unseen contexts is nothing."""
    weights, last = np.zeros((BUCKETS, 3)), np.array([0.0, 0.0, 1.0])
    for bucket in range(BUCKETS):
        own = cells[cells["bucket"] == bucket]
        if len(own):
            p = np.stack([
                np.where(own["f2"] > 0, 2.0 ** (-(own["f2"] - 1) / PER_OCTAVE), 0.0),
                np.where(own["f1"] > 0, 2.0 ** (-(own["f1"] - 1) / PER_OCTAVE), 0.0),
                np.full(len(own), 1 / (kinds + 1)),
            ], axis=1)
            n, mix = own["n"].to_numpy(float), np.full(3, 1 / 3)
            for _ in range(ROUNDS):
                joint = p * mix
                mix = (joint / joint.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            last = np.maximum(mix, 1e-6) / np.maximum(mix, 1e-6).sum()
            if bucket == 0:
                last = np.array([0.0, *(last[1:] / last[1:].sum())])
        weights[bucket] = last
    return weights


def score(docs: DataFrame) -> DataFrame:
    """One row per document: base unigram score and the model's log10 probability of the text.

    The estimates come from counted training documents, their weights by expectation-maximisation from the tokens of teaching ones,
    a tenth of the training documents by the hash of the text; the base counts all training documents. A null text is empty: its one token is the end. Each row is scored, repeated or without an id as well (a null id counts
    as the empty text for its part). With no training tokens the model is uniform over one unknown token.

    Batches tokenise the texts once. Their distinct n-grams meet by ranges of the key's hash, so a very common pair costs one
    entry per batch, and the totals travel back to the batches that asked. Only the table of held-out cells, whose size is
    bounded by its buckets, reaches the driver.
    """
    spark = docs.sparkSession
    batches = stage(tokenise(docs))
    keys = batches.agg(F.sum("n_keys")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(keys / TASK_KEYS))
    replies = stage(requests(batches, parts).groupBy("kind", "part").applyInPandas(add_up, REPLIES))
    tokens, kinds, counted = (x or 0 for x in replies.where("kind = 0").agg(F.sum("mass"), F.sum("known"), F.sum("counted")).first())
    answers = replies.groupBy("batch").agg(F.collect_list(F.struct("kind", "part", "totals")).alias("answers"))
    answered = stage(batches.drop("n_keys").join(answers, "batch"))
    weights = learn_weights(held_out_cells(answered, counted).toPandas(), kinds)

    def scored(row) -> pd.DataFrame:
        # A function of its own, so that the arrays of one batch are gone before the next one's are made.
        batch, known, c2, c1, c12 = _answered(row)
        base, logs = np.empty(len(known)), np.empty(len(known))
        for at in range(0, len(known), SLICE):
            i = slice(at, at + SLICE)
            mix = weights[np.minimum(_bucket(c1[i]), BUCKETS - 1)]
            p = mix[:, 0] * c12[i] / np.maximum(c1[i], 1) + mix[:, 1] * c2[i] / max(counted, 1) + mix[:, 2] / (kinds + 1)
            base[i], logs[i] = np.log10((known[i] + 0.5) / (tokens + 0.5 * (kinds + 1))), np.log10(p)
        return pd.DataFrame({
            "doc_id": pd.array([None if d is None or d != d else int(d) for d in row.doc_ids], "Int64"),
            "held_out": batch.held, "n_tokens": batch.lens,
            "n_known": np.add.reduceat((known > 0).astype(np.int64), batch.starts), "train_tokens": tokens,
            "base_score": np.add.reduceat(base, batch.starts), "score": np.add.reduceat(logs, batch.starts),
        })

    def rows(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for row in table.itertuples(index=False):
                yield scored(row)

    return answered.mapInPandas(rows, SCORES)
