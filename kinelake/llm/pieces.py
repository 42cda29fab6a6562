"""SentencePiece encoding by Gumbel top-k: distinct sampled segmentations from perturbed search, and decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES, SEED = 3, 6
BLANK = "▁"
#: Pieces are weighted by the rank that the vocabulary file gives them (Zipf with this shift); a byte of an unknown character
#: weighs as the last rank.
SHIFT = 2.7
#: Pieces with a score below this are out of use in the file; single characters (the blank mark) then count as last in rank.
UNUSED = -1e8
#: Bytes of texts that share lattices, characters of segments whose lattices are built at once, segments searched together, and
#: edges of lattices kept for later texts.
CHUNK_BYTES, PORTION_CHARS, BLOCK_SEGMENTS, KEPT_EDGES = 1 << 21, 1 << 16, 1 << 14, 1 << 20
#: So many ways are followed one by one.
FEW = 8
BASE = np.uint64(0x9E3779B97F4A7C15)

SAMPLED = "doc_id long, sample int, log_prob double, inclusion double, ids array<int>, round_trip boolean"


class Pieces:
    """Pieces of a vocabulary file's content, with hashes of all their prefixes by length."""

    def __init__(self, model: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_of: list[bytes] = []
        self.byte_ids = {}
        known: dict[str, tuple[int, float]] = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes_of.append(bytes([int(name[3:5], 16)]))
                continue
            special = model.is_control(i) or model.is_unknown(i)
            self.bytes_of.append(b"" if special else name.replace(BLANK, " ").encode())
            used = model.get_score(i) > UNUSED
            if not special and (used or len(name) == 1):
                if BLANK in name[1:] or "\n" in name:
                    raise ValueError("a piece reaches across words")
                known[name] = (i, -np.log((-model.get_score(i) if used else len(names)) + SHIFT))
        total = np.log(sum(np.exp(p) for _, p in known.values()))
        self.byte_weight = -np.log(len(names) + SHIFT) - total
        prefixes: list[dict[int, tuple[int, float]]] = [{} for _ in range(max(map(len, known)) + 1)]
        for name, (i, p) in known.items():
            h = 0
            for n, c in enumerate(name, 1):
                h = ((h + ord(c) + 1) * int(BASE)) & 0xFFFFFFFFFFFFFFFF
                if n < len(name):
                    prefixes[n].setdefault(h, (-1, 0.0))
            prefixes[len(name)][h] = (i, p - total)
        self.tables = []
        for table in prefixes[1:]:
            # The last key stands for none; the first key of each range of equal leading bits.
            keys = np.array([*sorted(table), (1 << 64) - 1], np.uint64)
            found = [table.get(k, (-1, 0.0)) for k in keys.tolist()]
            bits = len(keys).bit_length() + 1
            heads = np.searchsorted(keys[:-1] >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
            self.tables.append((
                keys, np.array([i for i, _ in found], np.int64), np.array([p for _, p in found]), heads, np.uint64(64 - bits),
            ))

        sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat, self.sizes, self.places = np.frombuffer(b"".join(self.bytes_of), np.uint8), sizes, np.cumsum(sizes) - sizes

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def spelt(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with those of unknown characters (-1 - code point) as their bytes, and how many each became."""
        counts = np.ones(len(ids), np.int64)
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, counts
        chars, which = np.unique(ids[unknown], return_inverse=True)
        spelt = [self.fallback(chr(-1 - c)) for c in chars.tolist()]
        sizes = np.array([len(x) for x in spelt], np.int64)
        counts[unknown] = sizes[which]
        out = np.repeat(ids, counts)
        firsts = (np.cumsum(counts) - counts)[unknown]
        out[ranges(firsts, sizes[which])] = np.concatenate([np.array(x, ids.dtype) for x in spelt])[
            ranges((np.cumsum(sizes) - sizes)[which], sizes[which])
        ]
        return out, counts

    def spelling(self, ids: np.ndarray) -> bytes:
        return self.flat[ranges(self.places[ids], self.sizes[ids])].tobytes()


@lru_cache(maxsize=1)
def loaded(model: bytes) -> Pieces:
    """The pieces of a file's content, built once per worker process."""
    return Pieces(model)


def ranges(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each first on, as many as its size, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(firsts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def scrambled(keys: np.ndarray) -> np.ndarray:
    """The output function of SplitMix64."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def uniform(keys: np.ndarray) -> np.ndarray:
    """Uniform variables in [0, 1) that depend on the keys alone: the generator SplitMix64 at any place of its sequence."""
    return (scrambled(keys) >> np.uint64(11)) * 2.0**-53


class Lattices:
    """Lattices of distinct segments in one numbering of nodes: the edges into each node, with their share of all ways there.

    Nothing of a segment's lattice but its numbers depends on the other segments, to the last bit.
    """

    def __init__(self, segments: list[str], pieces: Pieces):
        text = "".join(segments)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lens = np.array([len(s) for s in segments], np.int64)
        firsts = np.cumsum(lens) - lens
        # Node of a place in a segment: every segment has one node more than characters.
        node = np.arange(len(codes)) + np.repeat(np.arange(len(segments)), lens)
        rest = np.repeat(firsts + lens, lens) - np.arange(len(codes))
        alive, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found = []
        for n, (keys, numbers, probs, heads, bits) in enumerate(pieces.tables, 1):
            if n > 1:
                keep = np.flatnonzero(rest[alive] >= n)
                alive, hashes = alive[keep], hashes[keep]
            hashes = (hashes + codes[alive + (n - 1)] + np.uint64(1)) * BASE
            place = heads[hashes >> bits].astype(np.int64)
            late = np.flatnonzero(keys[place] < hashes)
            while len(late):
                place[late] += 1
                late = late[keys[place[late]] < hashes[late]]
            keep = np.flatnonzero(keys[place] == hashes)
            alive, hashes, place = alive[keep], hashes[keep], place[keep]
            number = numbers[place]
            real = np.flatnonzero(number >= 0)
            starts = alive[real]
            found.append((node[starts], n, number[real].astype(np.int32), probs[place[real]]))
            if n == 1:
                lost = np.ones(len(codes), bool)
                lost[starts] = False
            if not len(alive):
                break
        unknown = np.flatnonzero(lost)
        chars = codes[unknown].astype(np.int64)
        spelt = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        found.append((node[unknown], 1, (-1 - chars).astype(np.int32), spelt * pieces.byte_weight))
        self.first = firsts + np.arange(len(segments))
        self.last = self.first + lens
        # Edges into a node lie together, the longest first; of one length only one ends there.
        nodes = len(codes) + len(segments)
        degree = np.zeros(nodes, np.int64)
        for starts, n, _, _ in found:
            degree[starts + n] += 1
        self.edges = np.concatenate([[0], np.cumsum(degree)])
        free, total = self.edges[:-1].copy(), int(self.edges[-1])
        self.start, self.ids, weight = np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total)
        spots = []
        for starts, n, number, prob in reversed(found):
            spot = free[starts + n]
            free[starts + n] += 1
            self.start[spot], self.ids[spot], weight[spot] = starts, number, prob
            spots.append((starts + n, spot))
        # Log of the summed weight of all ways to each node, one distance from the segment's start at a time.
        ways = np.zeros(nodes)
        self.log_share = np.empty(total)
        distance = np.arange(nodes) - np.repeat(self.first, lens + 1)
        far = int(lens.max())
        by_distance = np.argsort(distance.astype(np.uint16 if far < 1 << 16 else np.int64), kind="stable")
        cuts = np.cumsum(np.bincount(distance))
        degree = degree[by_distance]
        edges = ranges(self.edges[by_distance], degree)
        heads = np.cumsum(degree) - degree
        start, weight = self.start[edges], weight[edges]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            i, j = int(heads[a]), int(heads[b]) if b < nodes else total
            values, own, many = ways[start[i:j]] + weight[i:j], heads[a:b] - i, degree[a:b]
            top = np.maximum.reduceat(values, own)
            top += np.log(np.add.reduceat(np.exp(values - np.repeat(top, many)), own))
            ways[by_distance[a:b]] = top
            self.log_share[edges[i:j]] = values - np.repeat(top, many)
        # Upper ends of the edges' shares of [0, 1) at their node; that of the last edge is out of reach.
        share, below = np.exp(self.log_share), np.zeros(nodes)
        self.reach = np.empty(total)
        for end, spot in spots:
            below[end] += share[spot]
            self.reach[spot] = below[end]
        self.reach[self.edges[1:][self.edges[1:] > self.edges[:-1]] - 1] = 2.0

    def head(self, n: int) -> Lattices:
        """The first ``n`` segments."""
        some, nodes = object.__new__(Lattices), int(self.last[n - 1]) + 1
        some.first, some.last, some.edges = self.first[:n].copy(), self.last[:n].copy(), self.edges[: nodes + 1].copy()
        for name in ("start", "ids", "log_share", "reach"):
            setattr(some, name, getattr(self, name)[: some.edges[-1]].copy())
        return some

    def walk(self, nodes: np.ndarray, firsts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample a way back from each node to its segment's start: edges, one way after the other, and their number by way.

        The choice at a node depends on the way's key and the node's distance from the segment's start only.
        """
        counts = np.zeros(len(nodes), np.int64)
        at = np.flatnonzero(nodes > firsts)
        here, first = nodes[at], firsts[at]
        key = keys[at] - first.astype(np.uint64) * BASE
        taken, tails = [], []
        while len(at) > FEW:
            drawn = uniform(key + here.astype(np.uint64) * BASE)
            edge = self.edges[here]
            late = np.flatnonzero(drawn >= self.reach[edge])
            while len(late):
                edge[late] += 1
                late = late[drawn[late] >= self.reach[edge[late]]]
            taken.append((at, edge))
            counts[at] += 1
            here = self.start[edge]
            more = np.flatnonzero(here > first)
            if len(more) < len(at):
                at, here, first, key = at[more], here[more], first[more], key[more]
        # The last ways are long ones: each is followed to its end by itself.
        for i, node, least, own in zip(at.tolist(), here.tolist(), first.tolist(), key, strict=True):
            tails.append((i, self.follow(node, least, own)))
            counts[i] += len(tails[-1][1])
        places = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), np.int64)
        for step, (at, edge) in enumerate(taken):
            edges[places[at] + step] = edge
        for i, tail in tails:
            edges[places[i] + len(taken) : places[i] + counts[i]] = tail
        return edges, counts

    def follow(self, node: int, first: int, key: np.uint64) -> list[int]:
        """The edges of one way from a node to its segment's start, chosen as in ``walk``."""
        drawn = uniform(key + np.arange(first, node + 1, dtype=np.uint64) * BASE).tolist()
        heads = self.edges[first : node + 1].tolist()
        some = slice(heads[0], int(self.edges[node + 1]))
        start, reach, taken = self.start[some].tolist(), self.reach[some].tolist(), []
        while node > first:
            edge, value = heads[node - first] - heads[0], drawn[node - first]
            while value >= reach[edge]:
                edge += 1
            taken.append(edge + heads[0])
            node = start[edge]
        return taken


def joined(parts: list[Lattices]) -> Lattices:
    """The segments of all parts, one part after the other."""
    if len(parts) == 1:
        return parts[0]
    whole = object.__new__(Lattices)
    nodes = np.cumsum([0, *(len(p.edges) - 1 for p in parts)])
    edges = np.cumsum([0, *(len(p.ids) for p in parts)])
    for name in ("ids", "log_share", "reach"):
        setattr(whole, name, np.concatenate([getattr(p, name) for p in parts]))
    for name in ("first", "last", "start"):
        setattr(whole, name, np.concatenate([getattr(p, name) + n for p, n in zip(parts, nodes, strict=False)]))
    whole.edges = np.concatenate([*(p.edges[:-1] + n for p, n in zip(parts, edges, strict=False)), edges[-1:]])
    return whole


def below(place: float, limit: float, drawn: float) -> float:
    """A Gumbel variable at ``place``, given that it is below ``limit``."""
    if place == -math.inf:
        return place
    over, drawn = place - limit, -math.log1p(-drawn)
    return limit - math.log1p(drawn * math.exp(-over)) if over > 0 else place - math.log(math.exp(over) + drawn)


class Way:
    """One sampled segmentation, its edges from the text's end to its start, and the choices left aside on it.

    The choices left aside from step ``since`` on make one set of subtrees, with ``rest`` as their share at each step. ``mass`` has
    the share of each step's subtrees relative to what comes before ``since``, ``bound`` the largest perturbed log probability in all of them: the maximum of independent
    Gumbel variables below the same limit is one at their summed mass, and lies in each of them in proportion to its mass.
    """

    def __init__(
        self, edges: np.ndarray, counts: np.ndarray, steps: np.ndarray, rest: np.ndarray, value: float, since: int, drawn: float
    ):
        self.edges, self.counts, self.since = edges, counts, since
        self.before = np.zeros(len(steps) + 1)
        steps.cumsum(out=self.before[1:])
        self.mass = np.exp(self.before[since:-1] - self.before[since]) * rest
        self.barred: dict[int, list[int]] = {}
        self.draw(value, drawn)

    def draw(self, limit: float, drawn: float) -> None:
        total = float(self.mass.sum())
        self.bound = below(float(self.before[self.since]) + math.log(total), limit, drawn) if total > 0 else -math.inf

    def leave(self, lattices: Lattices, lasts: np.ndarray, drawn: list[float]) -> tuple[int, int, int]:
        """Search the set left aside: the step and the segment where the way of its bound turns off, and the edge taken there.

        What is left of the set is drawn anew, below the old bound.
        """
        sums = np.cumsum(self.mass)
        step = int(np.searchsorted(sums, drawn[0] * sums[-1], side="right"))
        if step == len(sums) or not self.mass[step]:
            step = int(np.flatnonzero(self.mass)[-1])
        at = self.since + step
        ends = np.cumsum(self.counts)
        owner = int(np.searchsorted(ends, at, side="right"))
        here = lasts[owner] if at == ends[owner] - self.counts[owner] else lattices.start[self.edges[at - 1]]
        barred = self.barred.setdefault(at, [int(self.edges[at])])
        options = [e for e in range(int(lattices.edges[here]), int(lattices.edges[here + 1])) if e not in barred]
        shares = [math.exp(lattices.log_share[e]) for e in options]
        pick, rest = 0, drawn[1] * sum(shares)
        while pick < len(options) - 1 and rest >= shares[pick]:
            rest -= shares[pick]
            pick += 1
        barred.append(options[pick])
        self.mass[step] = math.exp(self.before[at] - self.before[self.since]) * sum(shares[:pick] + shares[pick + 1 :])
        self.draw(self.bound, drawn[2])
        return at, owner, options[pick]


def sample_all(
    texts: list[np.ndarray], lattices: Lattices, k: int, seeds: np.ndarray
) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text (its segments) ``k`` distinct segmentations without replacement: (edges in text order, log probability,
    inclusion probability).

    Every set of subtrees of choices has the largest perturbed log probability of its leaves as exact bound. In each text the best
    open set is always the next to be searched, and a walk down it keeps its value, so each search ends in the next best leaf;
    the walks of all texts take their steps together. Fewer come back if a lattice has fewer. The value after the k-th is the
    threshold of the inclusion probabilities. What is drawn for a text depends on its seed only.
    """
    if not texts:
        return []
    # Segments from each text's end to its start, as the edges of a way come.
    segments = np.concatenate([own[::-1] for own in texts])
    sizes = np.array([len(own) for own in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    lasts, firsts = lattices.last[segments], lattices.first[segments]
    nodes = lasts - firsts + 1
    places = np.cumsum(nodes) - nodes
    places -= np.repeat(places[begins], sizes)
    # One sequence for the walks of each round, one for all else.
    sequences = scrambled(seeds[:, None] + np.arange(1, k + 2, dtype=np.uint64) * BASE)
    draws = iter(uniform(sequences[:, -1:] + np.arange(1, 4 * k + 1, dtype=np.uint64) * BASE).T)

    def walks(n: int, some: np.ndarray, skipped: np.ndarray, heads: np.ndarray | None) -> Iterator[tuple]:
        """Ways through the texts from a segment on, whose node may be given, with the log shares of their steps and what those leave."""
        many = ends[some] - begins[some] - skipped
        which = ranges(begins[some] + skipped, many)
        from_, cuts = lasts[which], np.cumsum(many)
        if heads is not None:
            from_[cuts - many] = heads
        keys = np.repeat(sequences[some, n], many) + places[which].astype(np.uint64) * BASE
        edges, counts = lattices.walk(from_, firsts[which], keys)
        steps, sums = lattices.log_share[edges], np.concatenate([[0], np.cumsum(counts)])
        share = np.exp(steps)
        rest = np.where(share < 1 - 1e-12, 1.0 - share, 0.0)
        for i, j, a, b in zip(*(x.tolist() for x in (cuts - many, cuts, sums[cuts - many], sums[cuts])), strict=True):
            yield edges[a:b], counts[i:j], steps[a:b], rest[a:b]

    everyone = np.arange(len(texts))
    values, asides = next(draws).tolist(), next(draws).tolist()
    ways = [
        [Way(edges, counts, steps, rest, -math.log(-math.log1p(-value) or 5e-324), 0, aside)]
        for (edges, counts, steps, rest), value, aside in zip(walks(0, everyone, 0 * everyone, None), values, asides, strict=True)
    ]
    for n in range(1, k):
        drawn = np.stack([next(draws) for _ in range(4)], axis=1).tolist()
        turns = []
        for i, own in enumerate(ways):
            way = max(own, key=lambda w: w.bound)
            if way.bound > -math.inf:
                turns.append((i, way, way.bound, *way.leave(lattices, lasts[begins[i] : ends[i]], drawn[i])))
        if not turns:
            break
        # Earlier choices stay; the rest of this segment and all later ones are sampled anew.
        others = np.array([t[5] for t in turns])
        new = walks(n, np.array([t[0] for t in turns]), np.array([t[4] for t in turns]), lattices.start[others])
        for (i, way, value, at, owner, other), (edges, counts, steps, rest) in zip(turns, new, strict=True):
            counts = np.concatenate([way.counts[:owner], counts])
            counts[owner] += at + 1 - int(way.counts[:owner].sum())
            edges = np.concatenate([way.edges[:at], [other], edges])
            steps = np.concatenate([lattices.log_share[edges[: at + 1]], steps])
            ways[i].append(Way(edges, counts, steps, rest, value, at + 1, drawn[i][3]))
    out = []
    for own in ways:
        threshold = max(w.bound for w in own)
        log_probs = [float(w.before[-1]) for w in own]
        with np.errstate(over="ignore"):
            inclusions = [1.0 if threshold == -math.inf else float(-np.expm1(-np.exp(p - threshold))) for p in log_probs]
        out.append([(w.edges[::-1], p, q) for w, p, q in zip(own, log_probs, inclusions, strict=True)])
    return out


def sample(segments: np.ndarray, lattices: Lattices, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, float, float]]:
    """The segmentations of one text, its seed drawn from a generator."""
    return sample_all([segments], lattices, k, rng.integers(1 << 64, size=1, dtype=np.uint64))[0]


def decode_ids(ids, pieces: Pieces) -> str:
    """The text of ids; the blank in front goes. Bytes that are no UTF-8 become replacement characters."""
    raw = b"".join(map(pieces.bytes_of.__getitem__, ids))
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def shipped(df: DataFrame, model_file: str) -> Broadcast[bytes]:
    """The content of a vocabulary file (some hundred kilobytes), read by the driver: workers need no file of their own."""
    return df.sparkSession.sparkContext.broadcast(Path(model_file).read_bytes())


def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (null: empty) of rows in chunks of about CHUNK_BYTES, whatever the sizes of the batches."""
    held, size = [], 0
    for part in parts:
        texts = pc.fill_null(part.column(1).cast(pa.large_string()), "")
        sums, i = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while i < len(texts):
            # Up to the row that fills the chunk.
            before = int(sums[i - 1]) if i else 0
            j = min(int(np.searchsorted(sums, before + CHUNK_BYTES - size)) + 1, len(texts))
            held.append((part.column(0)[i:j], texts[i:j]))
            size += int(sums[j - 1]) - before
            if size >= CHUNK_BYTES:
                yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))
                held, size = [], 0
            i = j
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))


def blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts with about BLOCK_SEGMENTS segments each."""
    first, total = 0, 0
    for i, n in enumerate(sizes, 1):
        total += n
        if total >= BLOCK_SEGMENTS or i == len(sizes):
            yield first, i
            first, total = i, 0


def spoken(texts: pa.Array) -> list[bytes]:
    """What decoding should give: the texts with their blank marks as blanks."""
    return pc.replace_substring(texts, BLANK, " ").cast(pa.large_binary()).to_pylist()


class Store:
    """Lattices of segments, by the tokens that stand for them; those that one chunk had more than once are kept for the next."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.tokens = pieces, pa.array([], pa.large_string())
        self.lattices: Lattices | None = None

    def segments(self, texts: pa.Array) -> tuple[list[np.ndarray], Lattices | None]:
        """The numbers of each text's segments, and the lattices that these numbers mean until the next call."""
        self.lattices = self.lattices.head(len(self.tokens)) if len(self.tokens) else None
        if self.lattices is not None and len(self.lattices.ids) > KEPT_EDGES:
            self.tokens, self.lattices = pa.array([], pa.large_string()), None
        # As the vocabulary wants it: a blank in front, blanks as their mark, nothing else changed; an empty text stays empty.
        # A line's end is a token of its own, and one more begins what follows, which has no blank in front.
        marked = pc.replace_substring(pc.replace_substring(texts, " ", BLANK), "\n", f"{BLANK}\n\n{BLANK}\n")
        full = pc.greater(pc.binary_length(texts), 0)
        tokens = pc.split_pattern(marked.filter(full), BLANK)
        sizes = np.zeros(len(texts), np.int64)
        sizes[full.to_numpy(zero_copy_only=False)] = pc.list_value_length(tokens).to_numpy()
        coded = pc.list_flatten(tokens).dictionary_encode()
        which, names = coded.indices.to_numpy(), coded.dictionary
        if not len(names):
            return [np.empty(0, np.int64) for _ in range(len(texts))], None
        number = pc.fill_null(pc.index_in(names, value_set=self.tokens), -1).to_numpy().astype(np.int64)
        nothing = pc.equal(names, "\n").to_numpy(zero_copy_only=False)
        new, many = np.flatnonzero((number < 0) & ~nothing), np.bincount(which, minlength=len(names))
        often = many[new] > 1
        new, known = np.concatenate([new[often], new[~often]]), len(self.tokens)
        number[new] = np.arange(known, known + len(new))
        lattices = self.lattices
        if len(new):
            added = names.take(pa.array(new))
            self.tokens = pa.concat_arrays([self.tokens, added[: int(often.sum())]])
            cuts = np.flatnonzero(np.diff(np.cumsum(pc.utf8_length(added).to_numpy()) // PORTION_CHARS)) + 1
            added = added.to_numpy(zero_copy_only=False).tolist()
            added = [BLANK + t if t[:1] != "\n" else "\n" if t == "\n\n" else t[1:] for t in added]
            more = [Lattices(added[i:j], self.pieces) for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(added)], strict=True)]
            lattices = joined(more if lattices is None else [lattices, *more])
        self.lattices = lattices
        there = ~nothing[which]
        sums = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        segments = number[which[there]]
        return [segments[i:j] for i, j in zip(sums[:-1], sums[1:], strict=True)], lattices


def encoded(
    keys: list[int | None], wanted: list[bytes], segments: list[np.ndarray], texts: pa.Array, lattices: Lattices | None,
    pieces: Pieces, k: int, seed: int,
) -> list[pa.Array]:
    """The columns of SAMPLED for a run of texts."""
    full = [i for i, own in enumerate(segments) if len(own)]
    names = [texts[i].as_py() if keys[i] is None else str(keys[i]) for i in full]
    seeds = np.array([xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass"), seed) for n in names], np.uint64)
    found = dict(zip(full, sample_all([segments[i] for i in full], lattices, k, seeds), strict=True))
    empty = [(np.empty(0, np.int64), 0.0, 1.0)]
    rows = [(i, n, *way) for i in range(len(segments)) for n, way in enumerate(found.get(i, empty))]
    sizes = np.array([len(r[2]) for r in rows], np.int64)
    edges = np.concatenate([r[2] for r in rows])
    ids, counts = pieces.spelt(lattices.ids[edges] if lattices is not None else np.empty(0, np.int32))
    ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
    raw = pieces.spelling(ids)
    cuts = np.concatenate([[0], np.cumsum(pieces.sizes[ids])])[ends].tolist()
    same = [agrees(raw[i:j], wanted[r[0]]) for i, j, r in zip(cuts[:-1], cuts[1:], rows, strict=True)]
    return [
        pa.array([keys[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
        pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.float64()),
        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(same, pa.bool_()),
    ]


def agrees(raw: bytes, wanted: bytes) -> bool:
    raw = raw.removeprefix(b" ")
    return raw == wanted or raw.decode("utf-8", "replace") == wanted.decode()


def encode(docs: DataFrame, model_file: str, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Up to ``k`` distinct sampled segmentations of every whole text, one row each: doc_id, sample, log_prob, inclusion, ids
    and round_trip (whether decoding gives the text back, its blank marks read as blanks).

    Rows draw from a generator seeded by their doc_id, so reruns and other partitionings agree; repeated rows agree too. A null
    or empty text has one segmentation, without ids. Rows without an id are seeded by their text. A very long text is searched
    whole; an empty table gives no rows; further columns are ignored.
    """
    model = shipped(docs, model_file)
    names = [f.split()[0] for f in SAMPLED.split(", ")]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(loaded(model.value))
        for keys, texts in chunks(parts):
            keys, wanted = keys.to_pylist(), spoken(texts)
            own, lattices = store.segments(texts)
            for i, j in blocks([len(x) for x in own]):
                yield pa.RecordBatch.from_arrays(encoded(keys[i:j], wanted[i:j], own[i:j], texts[i:j], lattices, store.pieces, k, seed), names=names)
            # The store lets go of what it doesn't keep before it builds anew.
            del lattices

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(rows, SAMPLED)


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """The texts of id lists as a further column. Null ids give a null text, empty ones an empty text."""
    kept = [c for c in encoded.columns if c != into]
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.select(*kept).dtypes) + f", `{into}` string"

    model = shipped(encoded, model_file)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value)
        for part in parts:
            texts = [None if x is None else decode_ids(x, pieces) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    return encoded.select(*kept).mapInArrow(rows, schema)
