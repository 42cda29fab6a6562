"""Secret scans: fixed patterns, and a character convolutional network over every candidate with its context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import stage

# The base kinds in their order, and how long a match must be.
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_CHARS = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX_CHARS, HEX_LEAST = "0123456789abcdef", 32
#: A candidate is a run of the base pattern's token characters of the base pattern's least length, whatever it is made of.
TOKEN_CHARS, TOKEN_LEAST = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", 8

#: Characters on either side of a candidate that the network sees beside the whole candidate.
CONTEXT = 40
#: The network is fitted on at most so many distinct findings of either label, taken by hash, of at most so many characters.
EXAMPLES, FIT_CHARS = 1500, 400
FILTERS, REACH, DIMS, EPOCHS, BATCH, RATE = 24, 5, 12, 6, 64, 0.004
#: Share of held-out findings that the threshold must still find; windows are held out by hash, one part of so many.
RECALL, PARTS = 0.98, 5
#: Logits meet as a histogram: so many bins over this range to either side.
BINS, RANGE = 1 << 14, 64.0
SEED = 5
#: Characters of texts that are read together, and positions that are convolved together.
READ_CHARS, TILE = 1 << 20, 1 << 15

SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
SCORED = "doc_id long, base array<struct<start:int,end:int,kind:string>>, starts binary, ends binary, flags binary, logits binary"
BASE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
LABEL, APART = 1, 2


def class_of(characters: str) -> np.ndarray:
    held = np.zeros(128, bool)
    held[[ord(c) for c in characters]] = True
    return held


IS_TOKEN, IS_HEX = class_of(TOKEN_CHARS), class_of(HEX_CHARS)


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of true entries of at least this length."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    long_ = ends - starts >= least
    return starts[long_], ends[long_]


def codes_of(text: str) -> np.ndarray:
    """One byte per code point: 7-bit characters as they are, others as 127."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, 127).astype(np.uint8)


def base_spans(text: str, codes: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    codes = codes_of(text) if codes is None else codes
    spans = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "key")):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    spans += [(int(s), int(e), 2) for s, e in zip(*runs(IS_HEX[codes], HEX_LEAST), strict=True)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(spans, key=lambda x: (x[0], x[2]))]


class Read:
    """Some texts as one array of codes with zeros between them: their base spans and candidates.

    ``starts`` and ``ends`` are places in that array, ``owner`` the text of each candidate, ``label`` whether a base span has it,
    ``key`` the hash of the candidate with its context: equal windows fall into the same part.
    """

    def __init__(self, texts: list[str]):
        gap = np.zeros(CONTEXT + REACH, np.uint8)
        parts, self.base, starts, ends, owner, label = [gap], [], [], [], [], []
        self.offsets, at = [], len(gap)
        for i, text in enumerate(texts):
            codes = codes_of(text)
            spans = base_spans(text, codes)
            s, e = runs(IS_TOKEN[codes], TOKEN_LEAST)
            hit = np.zeros(len(s), bool)
            if spans:
                first, reach = np.array([x[0] for x in spans]), np.maximum.accumulate([x[1] for x in spans])
                before = np.searchsorted(first, e, "left")
                hit = (before > 0) & (reach[np.maximum(before - 1, 0)] > s)
            self.base.append(spans)
            self.offsets.append(at)
            starts.append(s + at), ends.append(e + at), owner.append(np.full(len(s), i)), label.append(hit)
            parts += [codes, gap]
            at += len(codes) + len(gap)
        none = np.zeros(0, np.int64)
        self.codes = np.concatenate(parts)
        self.starts, self.ends, self.owner = (np.concatenate([none, *x]).astype(np.int64) for x in (starts, ends, owner))
        self.label = np.concatenate([np.zeros(0, bool), *label])
        data = self.codes.tobytes()
        spans = zip((self.starts - CONTEXT).tolist(), (self.ends + CONTEXT).tolist(), strict=True)
        self.key = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b], SEED) for a, b in spans), np.uint64, len(self.starts))
        self.apart = self.key % np.uint64(PARTS) == 0

    def window(self, i: int) -> bytes:
        """The codes of a candidate and its context, the candidate's own with the high bit set."""
        codes = self.codes[self.starts[i] - CONTEXT : self.ends[i] + CONTEXT].copy()
        codes[CONTEXT:-CONTEXT] |= 0x80
        return codes.tobytes()


def readings(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Read]]:
    """(doc_id, texts read together) of batches of doc_id and text."""
    for part in parts:
        held, size, first = [], 0, 0
        for row, value in enumerate(part.column(1)):
            text = value.as_py() or ""
            if held and size + len(text) > READ_CHARS:
                yield part.column(0).slice(first, len(held)), Read(held)
                held, size, first = [], 0, row
            held.append(text)
            size += len(text)
        if held:
            yield part.column(0).slice(first, len(held)), Read(held)


class CharNetwork:
    """Embedding, one convolution, maxima over the candidate and over all positions, and a logistic output."""

    def __init__(self, rng: np.random.Generator):
        self.embed = rng.normal(0, 0.3, (128, DIMS))
        self.kernel = rng.normal(0, 1 / np.sqrt(REACH * (DIMS + 1)), (REACH * (DIMS + 1), FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.2, 2 * FILTERS)
        self.shift = np.zeros(1)
        self.slope, self.offset = 1.0, 0.0  # calibration of the logit

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.out, self.shift]

    def forward(self, codes: np.ndarray, sizes: np.ndarray | None = None):
        """Windows as rows; ``sizes``: how many codes of each row count, the rest is padding."""
        inside = (codes >> 7).astype(float)
        letters = codes & 127
        x = np.concatenate([self.embed[letters], inside[..., None]], axis=2)
        patches = np.lib.stride_tricks.sliding_window_view(x, REACH, axis=1)  # N, positions, DIMS + 1, REACH
        patches = patches.transpose(0, 1, 3, 2).reshape(len(codes), -1, REACH * (DIMS + 1))
        hidden = np.maximum(patches @ self.kernel + self.bias, 0)
        if sizes is not None:
            hidden *= (np.arange(hidden.shape[1]) < (sizes - REACH + 1)[:, None])[..., None]
        own = hidden * inside[:, REACH // 2 : REACH // 2 + hidden.shape[1], None]
        tops = (own.argmax(axis=1), hidden.argmax(axis=1))
        pooled = np.concatenate([own.max(axis=1), hidden.max(axis=1)], axis=1)
        return letters, patches, tops, pooled, pooled @ self.out + self.shift[0]

    def logits(self, codes: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        cut = lambda i: None if sizes is None else sizes[i : i + 256]
        return np.concatenate([np.empty(0), *[self.forward(codes[i : i + 256], cut(i))[4] for i in range(0, len(codes), 256)]])

    def tables(self) -> tuple[np.ndarray, ...]:
        """The convolution as look-ups: embedding and kernel folded for two characters at a time, and the running sums of what
        places inside the candidate add."""
        kernel = self.kernel.reshape(REACH, DIMS + 1, FILTERS)
        tap = [self.embed @ kernel[r, :DIMS] for r in range(REACH)]
        pair = lambda a, b: (tap[a][:, None] + tap[b][None]).reshape(-1, FILTERS).astype(np.float32)
        inner = np.concatenate([np.zeros((1, FILTERS)), np.cumsum(kernel[:, DIMS], axis=0)])
        return pair(0, 1), pair(2, 3), (tap[4] + self.bias).astype(np.float32), inner.astype(np.float32)

    def scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logits of candidates of an array of codes: each position is convolved once, whichever windows hold it, in tiles.

        A window's positions are those whose taps all lie in it. Positions whose taps touch the candidate are computed with its
        mark, the others are shared. Maxima run over tiles, so a candidate may be of any length.
        """
        first, second, third, inner = self.tables()
        half, n = REACH // 2, len(starts)
        own, every = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float32)
        wide = codes.astype(np.int32)
        low, high = starts - CONTEXT + half, ends + CONTEXT - half

        def reduced(rows: np.ndarray, a: np.ndarray, b: np.ndarray, out: np.ndarray, which: np.ndarray) -> None:
            some = a < b
            if some.any():
                place = np.stack([a[some], b[some]], axis=1).ravel()
                best = np.maximum.reduceat(np.concatenate([rows, np.zeros((1, FILTERS), np.float32)]), place, axis=0)[::2]
                out[which[some]] = np.maximum(out[which[some]], best)

        for lo in range(half, len(codes) - half, TILE):
            hi = min(lo + TILE, len(codes) - half)
            which = np.arange(np.searchsorted(high, lo, "right"), np.searchsorted(low, hi, "left"))
            if not len(which):
                continue
            at = wide[lo - half : hi + half]
            m = hi - lo
            base = first[(at[:m] << 7) | at[1 : m + 1]] + second[(at[2 : m + 2] << 7) | at[3 : m + 3]] + third[at[4 : m + 4]]
            plain = np.maximum(base, 0)
            s, e = starts[which], ends[which]
            clip = lambda x: np.clip(x, lo, hi) - lo
            reduced(plain, clip(low[which]), clip(s - half), every, which)
            reduced(plain, clip(e + half), clip(high[which]), every, which)
            a, b = clip(s - half), clip(e + half)
            size = b - a
            begin = np.cumsum(size) - size
            place = np.arange(size.sum()) + np.repeat(a - begin, size)
            left = np.clip(np.repeat(s - lo, size) - (place - half), 0, REACH)
            right = np.clip(np.repeat(e - lo, size) - (place - half), 0, REACH)
            marked = np.maximum(base[place] + (inner[right] - inner[left]), 0)
            reduced(marked, begin, begin + size, every, which)
            reduced(marked, begin + clip(s) - a, begin + clip(e) - a, own, which)
        pooled = np.concatenate([own, every], axis=1).astype(np.float64)
        return (pooled * self.out).sum(axis=1) + self.shift[0]

    def chance(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -40, 40)))

    def gradients(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, sizes: np.ndarray | None = None) -> list[np.ndarray]:
        letters, patches, tops, pooled, logit = self.forward(codes, sizes)
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) * weights / len(codes)
        to_pool = (error[:, None] * self.out) * (pooled > 0)
        kernel, bias, embed = np.zeros_like(self.kernel), np.zeros_like(self.bias), np.zeros_like(self.embed)
        n = np.arange(len(codes))[:, None]
        for half, top in enumerate(tops):
            g = to_pool[:, half * FILTERS : (half + 1) * FILTERS]
            kernel += np.einsum("nf,nfk->kf", g, patches[n, top])
            bias += g.sum(axis=0)
            back = (g[:, :, None] * self.kernel.T[None]).reshape(len(codes), FILTERS, REACH, DIMS + 1)[..., :DIMS]
            for r in range(REACH):
                np.add.at(embed, letters[n, top + r], back[:, :, r])
        return [embed, kernel, bias, pooled.T @ error, np.array([error.sum()])]

    def fit(self, codes: np.ndarray, labels: np.ndarray, rng: np.random.Generator, sizes: np.ndarray | None = None) -> None:
        """Adam on the cross-entropy with classes of equal weight. In half of the examples the context to the left is another
        example's, so that a candidate's own shape is learned as well as the words before it."""
        share = max(labels.mean(), 1e-9)
        weights = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1e-9))
        first, second, step = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), BATCH):
                pick, step = order[at : at + BATCH], step + 1
                seen = codes[pick].copy()
                swap = rng.random(len(pick)) < 0.5
                seen[swap, :CONTEXT] = codes[rng.integers(0, len(codes), int(swap.sum())), :CONTEXT]
                cut = None if sizes is None else sizes[pick]
                seen = seen if cut is None else seen[:, : cut.max()]
                for p, g, m, v in zip(self.parameters(), self.gradients(seen, labels[pick], weights[pick], cut), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, logit: np.ndarray, labels: np.ndarray, number: np.ndarray) -> float:
        """Fit slope and offset of the logit to held-out findings, given by bins and their numbers; return the threshold that keeps
        the recall wanted there."""
        scale = max(np.abs(logit).max(), 1e-9)
        x, a, b = logit / scale, 1.0, 0.0
        good, bad = number[labels == 1].sum(), number[labels == 0].sum()
        targets = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))

        def loss(a: float, b: float) -> float:
            return float((number * (np.logaddexp(0, a * x + b) - targets * (a * x + b))).sum())

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
            w = number * np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
            move, size = np.linalg.solve(h, [(number * (p - targets) * x).sum(), (number * (p - targets)).sum()]), 1.0
            while size > 1e-6 and loss(a - size * move[0], b - size * move[1]) > loss(a, b):
                size /= 2
            a, b = a - size * move[0], b - size * move[1]
        self.slope, self.offset = max(a, 1e-6) / scale, b
        order = np.flatnonzero(labels == 1)[np.argsort(logit[labels == 1], kind="stable")]
        lost = np.cumsum(number[order]) > (1 - RECALL) * good
        least = logit[order[lost.argmax()]] - RANGE / BINS  # the lower edge of the bin
        if least <= -RANGE:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * least + self.offset, -40, 40))))


def learn(docs: DataFrame, examples: int = EXAMPLES) -> CharNetwork | None:
    """A network fitted on a bounded sample of distinct windows of either label, none of the held-out part; None with fewer than
    twenty of either. Each task keeps the windows with the least hashes, and so does the whole: which are taken depends on them alone."""

    def lowest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[int, bytes]] = [{}, {}]
        for _, read in readings(parts):
            fit = ~read.apart & (read.ends - read.starts <= FIT_CHARS)
            for label in (0, 1):
                mine = np.flatnonzero(fit & (read.label == label))
                mine = mine[np.argsort(read.key[mine], kind="stable")][: examples * 4]
                own = held[label]
                worst = max(own) if len(own) >= examples else None
                for i in mine:
                    key = int(read.key[i])
                    if worst is not None and key >= worst:
                        break
                    own[key] = read.window(i)
                held[label] = {k: own[k] for k in sorted(own)[:examples]}
        rows = [(label, key, window) for label in (0, 1) for key, window in held[label].items()]
        signed = np.array([r[1] for r in rows], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array(signed, pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
            names=["label", "key", "window"],
        )

    sample = stage(docs.select("doc_id", "text").mapInArrow(lowest, "label int, key long, window binary"))
    windows = sample.groupBy("window").agg(F.max("label").alias("label"), F.min("key").alias("key"))
    order = (F.shiftrightunsigned("key", 1), F.col("key"), F.col("window"))  # as unsigned numbers
    picked = [
        (bytes(r[0]), label)
        for label in (0, 1)
        for r in windows.where(F.col("label") == label).orderBy(*order).select("window").limit(examples).collect()
    ]
    labels = np.array([x[1] for x in picked], float)
    if min((labels == 0).sum(), (labels == 1).sum()) < 20:
        return None
    sizes = np.array([len(x[0]) for x in picked])
    codes = np.zeros((len(picked), sizes.max()), np.uint8)
    for row, (window, _) in zip(codes, picked, strict=True):
        row[: len(window)] = np.frombuffer(window, np.uint8)
    rng = np.random.default_rng(SEED)
    network = CharNetwork(rng)
    network.fit(codes, labels, rng, sizes)
    return network


def score(docs: DataFrame, network: CharNetwork | None) -> DataFrame:
    """Base spans of every row, and its candidates with their logits (none without a network)."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, read in readings(parts):
            logit = network.scores(read.codes, read.starts, read.ends) if network else np.zeros(0)
            cuts = np.searchsorted(read.owner, np.arange(len(ids) + 1)) if network else np.zeros(len(ids) + 1, int)
            flags = (read.label * LABEL + read.apart * APART).astype(np.uint8)
            packed: list[list[bytes]] = [[], [], [], []]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                at = read.offsets[i]
                packed[0].append((read.starts[a:b] - at).astype(np.int32).tobytes())
                packed[1].append((read.ends[a:b] - at).astype(np.int32).tobytes())
                packed[2].append(flags[a:b].tobytes())
                packed[3].append(logit[a:b].astype(np.float32).tobytes())
            base = [[{"start": s, "end": e, "kind": k} for s, e, k in spans] for spans in read.base]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(base, BASE_TYPE), *[pa.array(p, pa.binary()) for p in packed]],
                names=["doc_id", "base", "starts", "ends", "flags", "logits"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCORED)


def calibrated(network: CharNetwork, scored: DataFrame) -> float | None:
    """Calibrate a network on every held-out finding and return the threshold; None where one label has none."""

    def histogram(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for part in parts:
            flags = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8)
            logit = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float32)[(flags & APART) > 0].astype(float)
            bins = np.clip(((logit + RANGE) * (BINS / (2 * RANGE))).astype(int), 0, BINS - 1)
            np.add.at(total, ((flags & LABEL)[(flags & APART) > 0], bins), 1)
        label, bins = np.nonzero(total)
        columns = [pa.array(c, pa.int64()) for c in (label, bins, total[label, bins])]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "bin", "n"])

    counted = scored.select("flags", "logits").mapInArrow(histogram, "label long, bin long, n long")
    cells = counted.groupBy("label", "bin").agg(F.sum("n").alias("n")).orderBy("label", "bin").collect()
    label, bins, number = (np.array([r[i] for r in cells], float) for i in range(3))
    if not 0 < label.sum() < len(label):
        return None
    return network.calibrate((bins + 0.5) * (2 * RANGE / BINS) - RANGE, label, number)


def scan(docs: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, spans) of every row; spans by start, then kind as listed, each with its calibrated probability (base spans: 1).

    The base spans always stay. The network scores every candidate, whole and with ``CONTEXT`` characters on either side; one
    outside all base spans becomes a ``learned`` span if its probability reaches the threshold. Null and empty texts have no spans,
    repeated rows are scanned each, a null id stays null, very long texts and candidates are scored whole, an empty table gives no
    rows and further columns are ignored. Tables with fewer than twenty findings of either label train no network and get base
    spans only.

    Two passes over the texts: one keeps a bounded sample of windows, the other scores all candidates into a written table of
    places and logits, from which calibration, threshold and spans follow.
    """
    network = learn(docs, examples)
    scored = stage(score(docs, network))
    threshold = calibrated(network, scored) if network else None

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {k: i for i, k in enumerate(KINDS)}
        for part in parts:
            rows = []
            for base, starts, ends, flags, logits in zip(*(part.column(c).to_pylist() for c in ("base", "starts", "ends", "flags", "logits")), strict=True):
                spans = [(s["start"], rank[s["kind"]], s["end"], 1.0) for s in base]
                if threshold is not None and flags:
                    chance = network.chance(np.frombuffer(logits, np.float32).astype(float))
                    free = np.flatnonzero((np.frombuffer(flags, np.uint8) & LABEL == 0) & (chance >= threshold))
                    s, e = np.frombuffer(starts, np.int32), np.frombuffer(ends, np.int32)
                    spans += [(int(s[i]), rank["learned"], int(e[i]), float(chance[i])) for i in free]
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return scored.mapInArrow(judge, SPANS)
