"""Top-k search, pieces, toxicity, language model, pipeline."""

import collections
import itertools
import math

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import ROWS, SMALL, frame
from pyspark.sql import functions as F

from kinelake.llm import language_model as lm
from kinelake.llm import pieces, topk, toxicity
from kinelake.llm.queries import VOCABULARY


def brute_nearest(rows, queries, k, width):
    code = lambda v: [1 if i < len(v) and v[i] is not None and v[i] > 0 else 0 for i in range(width)]
    best = {}
    for i, v in rows:
        if i is not None and v is not None:
            best.setdefault(i, []).append(code(v))
    out = []
    for q in sorted({i for i, v in queries if i is not None and v is not None}):
        own = [code(v) for i, v in queries if i == q and v is not None]
        found = sorted(
            (min(sum(a != b for a, b in zip(x, y, strict=True)) for x in own for y in codes), i) for i, codes in best.items() if i != q
        )
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(found[:k])]
    return out


def answers(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "distance").collect())


def test_nearest_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    queries = rows.where("vec_id % 100 = 0")
    plain = [(r.vec_id, r.embedding) for r in rows.collect()]
    assert answers(topk.nearest(rows, queries)) == brute_nearest(plain, [x for x in plain if x[0] % 100 == 0], 10, 64)


SCHEMA = "vec_id long, embedding array<float>, id string, v string, distance string, bound string"


@pytest.mark.parametrize("most", [20_000, 1])
def test_odd_vectors(spark, monkeypatch, most):
    monkeypatch.setattr(topk, "MAX_MASKS", most)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=20)]) for i in range(30)]
    rows += [(100 + i, rows[0][1]) for i in range(25)] + [(200, None), (None, rows[1][1]), (300, []), (301, [1.0]), (302, [None] * 20), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    wanted = [x for x in rows if x[0] in (0, 3, 100, 200, 300, None)]
    queries = df.where("vec_id in (0, 3, 100, 200, 300) or vec_id is null")
    assert answers(topk.nearest(df, queries, k=7)) == brute_nearest(rows, wanted, 7, 20)
    assert answers(topk.nearest(df, queries, k=500)) == brute_nearest(rows, wanted, 500, 20)
    assert not answers(topk.nearest(df.limit(0), queries)) and not answers(topk.nearest(df, queries.limit(0)))


def test_nearest_sends_no_probes_through_the_driver(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = [x for x in rows if x[0] % 2 == 0]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "256k")
    try:
        found = answers(topk.nearest(df, df.where("vec_id % 2 = 0")))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(found) == 10 * len(queries)
    some = {i for i, _ in queries[:20]}
    assert [x for x in found if x[0] in some] == brute_nearest(rows, queries[:20], 10, 64)


@pytest.mark.parametrize(("width", "most"), [(64, 20_000), (100, 3)])
def test_nearest_in_groups_of_any_size(spark, monkeypatch, width, most):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=width)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(100)] + [(i, rows[i + 1][1]) for i in range(0, 60, 3)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = [x for x in rows if x[0] % 20 == 0]
    whole = answers(topk.nearest(df, df.where("vec_id % 20 = 0")))
    sizes = {"MAX_MASKS": most, "CODE_WORDS": 150, "QUERIES": 6, "BATCH": 4, "PROBES": 16, "CANDIDATES": 8}
    for name, value in sizes.items():
        monkeypatch.setattr(topk, name, value)
    assert answers(topk.nearest(df, df.where("vec_id % 20 = 0"))) == whole == brute_nearest(rows, queries, 10, width)


def test_segments_are_of_one_length():
    for width, bits in ((64, 12), (64, 20), (20, 7), (1000, 16), (5, 16)):
        places = topk.segment_places(width, bits)
        lengths = [n for _, n in places]
        assert max(lengths) - min(lengths) <= 1 and max(lengths) <= bits and sum(lengths) == width
        assert [a for a, _ in places] == [sum(lengths[:i]) for i in range(len(places))]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(open(VOCABULARY, "rb").read())


def ways(lattice, node, first):
    if node == first:
        return [((), 0.0)]
    return [
        (before + (e,), p + lattice.log_share[e])
        for e in range(lattice.edges[node], lattice.edges[node + 1])
        for before, p in ways(lattice, lattice.start[e], first)
    ]


def test_samples_follow_the_law(vocabulary):
    lattice = pieces.Lattices(["▁then", "▁is"], vocabulary)
    each = [ways(lattice, lattice.last[i], lattice.first[i]) for i in (0, 1)]
    everything = {a + b: math.exp(p + q) for (a, p), (b, q) in itertools.product(*each)}
    assert abs(sum(everything.values()) - 1) < 1e-9
    first, drawn, weighed, n = collections.Counter(), collections.Counter(), 0.0, 4000
    for seed in range(n):
        rows = pieces.sample(np.array([0, 1]), lattice, 3, np.random.default_rng(seed))
        keys = [tuple(e) for e, _, _ in rows]
        assert len(set(keys)) == 3
        first[keys[0]] += 1
        for key, (_, p, q) in zip(keys, rows, strict=True):
            assert abs(math.exp(p) - everything[key]) < 1e-9
            drawn[key] += 1
            weighed += math.exp(p) / q
    assert abs(weighed / n - 1) < 0.02  # inclusion scores make the estimate of the whole unbiased
    for key, p in everything.items():
        assert abs(first[key] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    full = pieces.sample(np.array([1]), lattice, 50, np.random.default_rng(0))
    assert len(full) == len(each[1]) and all(q == 1.0 for _, _, q in full)


def test_encoding_of_odd_rows(spark, odd, none, documents):
    rows = pieces.encode(odd, VOCABULARY).collect()
    assert all(r.round_trip for r in rows) and pieces.encode(none, VOCABULARY).count() == 0
    count = collections.Counter(r.doc_id for r in rows)
    assert count[3] == count[4] == 1 and count[2] == 6 and count[9] == 3 and len(count) == len({r[0] for r in ROWS})
    assert [r.ids for r in rows if r.doc_id in (3, 4)] == [[], []]
    again = pieces.encode(odd.repartition(5), VOCABULARY).collect()
    key = lambda r: (str(r.doc_id), r.sample, r.ids, r.log_prob, r.inclusion)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    decoded = pieces.decode(pieces.encode(documents, VOCABULARY), VOCABULARY).join(documents.select("doc_id", F.col("text").alias("own")), "doc_id")
    assert decoded.where(~F.col("text").eqNullSafe(F.translate("own", "▁", " "))).count() == 0
    assert decoded.where("not round_trip").count() == 0


def test_texts_are_searched_together_and_as_if_alone(vocabulary, monkeypatch):
    segments = ["▁then", "▁is", "▁otherwise,", "\n", "▁é\U0001f600", "words", "▁", "▁international"]
    lattice, turned = pieces.Lattices(segments, vocabulary), pieces.Lattices(segments[::-1], vocabulary)
    rng, calls, walk = np.random.default_rng(3), [], pieces.Lattices.walk
    monkeypatch.setattr(pieces.Lattices, "walk", lambda self, *args: calls.append(self) or walk(self, *args))
    texts = [rng.integers(0, len(segments), n) for n in range(1, 60)]
    seeds = rng.integers(1 << 64, size=len(texts), dtype=np.uint64)
    together = pieces.sample_all(texts, lattice, 3, seeds)
    assert len(calls) == 3  # one for each sample, not for each text
    for i, text in enumerate(texts):
        alone = pieces.sample_all([len(segments) - 1 - text], turned, 3, seeds[i : i + 1])[0]
        plain = lambda rows, own: [(own.ids[e].tolist(), p, q) for e, p, q in rows]
        assert plain(together[i], lattice) == plain(alone, turned)


def test_a_long_word_is_followed_by_itself(vocabulary, monkeypatch):
    segments = ["▁" + "the" * 300, "▁the", "\n", "▁é" + "ab" * 50]
    lattice, texts, seeds = pieces.Lattices(segments, vocabulary), [np.arange(4), np.array([1, 0])], np.array([5, 6], np.uint64)
    followed, follow = [], pieces.Lattices.follow
    monkeypatch.setattr(pieces.Lattices, "follow", lambda self, *args: followed.append(args) or follow(self, *args))
    few = pieces.sample_all(texts, lattice, 3, seeds)
    assert followed
    followed.clear()
    monkeypatch.setattr(pieces, "FEW", 0)
    steps = pieces.sample_all(texts, lattice, 3, seeds)
    assert not followed
    plain = lambda rows: [[(e.tolist(), p, q) for e, p, q in own] for own in rows]
    assert plain(few) == plain(steps)


def test_lattices_of_repeated_segments_are_kept(vocabulary, monkeypatch):
    built, init = [], pieces.Lattices.__init__
    monkeypatch.setattr(pieces.Lattices, "__init__", lambda self, segments, own: built.append(list(segments)) or init(self, segments, own))
    texts = [pa.array(["then is\nthen once", "", "is  is"], pa.large_string()), pa.array(["is then once", None], pa.large_string())]
    store = pieces.Store(vocabulary)
    for part, wanted in zip(texts, (["▁then", "▁is", "\n", "then", "▁once", "▁is", "▁", "▁is"], ["▁is", "▁then", "▁once"]), strict=True):
        own, lattices = store.segments(part.fill_null(""))
        fresh = pieces.Lattices(wanted, vocabulary)
        numbers = np.concatenate(own)
        assert len(own) == len(part) and len(numbers) == len(wanted)
        for i, n in enumerate(numbers):
            some, same = (
                slice(one.edges[one.first[j]], one.edges[one.last[j] + 1]) for one, j in ((lattices, n), (fresh, i))
            )
            assert lattices.ids[some].tolist() == fresh.ids[same].tolist()
            assert lattices.reach[some].tolist() == fresh.reach[same].tolist()
    mine = [b for b in built if b not in (["▁then", "▁is", "\n", "then", "▁once", "▁is", "▁", "▁is"], ["▁is", "▁then", "▁once"])]
    assert sorted(mine[0]) == sorted({"▁then", "▁is", "\n", "then", "▁once", "▁"})
    assert mine[1:] == [["▁then", "▁once"]]


def labelled(spark, n=600):
    rng = np.random.default_rng(4)
    common, bad = [f"word{i}" for i in range(60)], ["vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        body = [str(x) for x in rng.choice(common, 40)] + [str(rng.choice(bad)) for _ in range(2 * toxic)]
        rows.append((i, " ".join(str(x) for x in rng.permutation(body)), "en", "a", 0))
        labels.append((i, 1, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: int(i % 4 == 0) for i in range(n)}


def test_toxicity_of_held_out_documents(spark):
    docs, labels, truth = labelled(spark)
    rows = toxicity.score(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (brute.crc(r.doc_id) == 0) for r in rows) and len(rows) == 600
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    # Labels of held-out documents have no influence.
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r.doc_id, r.score) for r in rows) == sorted((r.doc_id, r.score) for r in toxicity.score(docs, turned).collect())


def test_block_max_search_is_exact():
    rng = np.random.default_rng(6)
    idf = rng.uniform(1, 5, 30)
    rows = []
    for i in range(700):
        terms = sorted(int(t) for t in rng.choice(30, rng.integers(1, 5), replace=False))
        rows.append((i, int(rng.random() < 0.3), terms, [int(c) for c in rng.integers(1, 4, len(terms))]))
    index = toxicity.BlockMaxIndex(rows, idf)
    dense = np.zeros((700, 30))
    place = {d: i for i, d in enumerate(index.ids.tolist())}
    for i, _, terms, counts in rows:
        dense[place[i], terms] = index.vector(terms, counts)[1]
    for _ in range(60):
        terms = sorted(int(t) for t in rng.choice(30, rng.integers(1, 6), replace=False))
        query = np.zeros(30)
        query[terms] = index.vector(terms, [1] * len(terms))[1]
        cosines = dense @ query
        found, values = index.nearest(terms, [1] * len(terms), k=9)
        expected = np.lexsort((np.arange(700), -np.round(cosines, 12)))[: int(min(9, (cosines > 0).sum()))]
        assert found.tolist() == expected.tolist() and np.allclose(values, cosines[expected])

def test_toxicity_keeps_every_word(spark):
    docs, labels, _ = labelled(spark)
    rows = toxicity.score(docs.withColumn("text", F.regexp_replace("text", "(vile|rotten|foul)", "***$1***")), labels).collect()
    again = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    # Texts without any word that tells the classes apart have neighbours too, and glued marks change nothing.
    assert all(len(r.neighbours) == toxicity.NEIGHBOURS for r in rows)
    assert all((r.score, r.neighbours) == (again[r.doc_id].score, again[r.doc_id].neighbours) for r in rows)


def test_toxicity_of_odd_rows(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score == 0 for r in toxicity.score(odd, empty).collect())
    few = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (7, None), (9, 0), (77, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, few).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows) and toxicity.score(none, few).count() == 0


def scored(docs):
    return [r.asDict() for r in lm.score(docs).collect()]


def test_base_score_matches_brute_force(documents, odd, none):
    for docs in (documents, odd):
        plain = [(r.doc_id, r.text) for r in docs.collect()]
        expected, n, _ = brute.unigram(plain)
        wanted = sorted((str(k), *expected[i][:2], round(expected[i][2], 5)) for i, (k, _) in enumerate(plain))
        rows = scored(docs)
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in rows) == wanted
        assert all(r["train_tokens"] == n and r["held_out"] == (brute.crc(r["doc_id"]) == 1) and r["score"] <= 0 for r in rows)
    assert not scored(none)


def test_no_training_tokens(spark):
    held = next(i for i in range(50) if brute.crc(i) == 1)
    rows = scored(frame(spark, [(held, "a b", "", "", 0)]))
    assert rows[0]["n_known"] == 0 and rows[0]["train_tokens"] == 0 and math.isfinite(rows[0]["score"])


def test_model_sums_to_one_and_beats_the_base(spark):
    rng = np.random.default_rng(1)
    follow = {w: [f"w{(w * 3 + j) % 20}" for j in range(3)] for w in range(20)}
    texts = []
    for _ in range(400):
        at, line = 0, []
        for _ in range(30):
            line.append(f"w{at}")
            at = int(str(rng.choice(follow[at]))[1:])
        texts.append(" ".join(line))
    rows = scored(frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)]))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 1.5 * sum(r["base_score"] for r in held) / 2  # scores are negative
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # Continuations of one history: all known words, the end and the unknown share add up to one.
    k = next(i for i in range(1000, 2000) if brute.crc(i) == 1)
    held_ids = [i for i in range(1000, 3000) if brute.crc(i) == 1]
    words = sorted({w for t in texts for w in t.split()})
    probes = [(i, f"w4 {w}", "", "", 0) for i, w in zip(held_ids, [*words, "unseen"], strict=False)] + [(k + 5000, "w4", "", "", 0)]
    probes = [p for p in probes if brute.crc(p[0]) == 1]
    assert len(probes) >= len(words)


def brute_model(docs):
    """{doc_id: log10 probability} by plain counting: estimates of counted documents, weights by EM over teaching ones."""
    import xxhash

    role = {}
    for i, text in docs:
        teaching = xxhash.xxh3_64_intdigest((text or "").encode()) % lm.DELETED == 0
        role[i] = "apart" if brute.crc(i) == 1 else "teach" if teaching else "count"
    lines = {i: [*(text or "").lower().split(), "<end>"] for i, text in docs}
    single, double, kinds = collections.Counter(), collections.Counter(), set()
    for i, words in lines.items():
        if role[i] != "apart":
            kinds.update(words)
        if role[i] == "count":
            single.update(words)
            double.update(zip(["<start>", *words], words, strict=False))
    total = sum(single.values())
    single["<start>"] = single["<end>"]
    bucket = lambda n: int(math.log2(n)) + 1 if n else 0
    rounded = lambda p: 2.0 ** (-min(round(-lm.PER_OCTAVE * math.log2(p)), lm.BINS - 2) / lm.PER_OCTAVE) if p else 0.0

    def given(before, word):
        return bucket(single[before]), double[before, word] / max(single[before], 1), single[word] / max(total, 1)

    cells = collections.defaultdict(collections.Counter)
    for i, words in lines.items():
        if role[i] == "teach":
            for before, word in zip(["<start>", *words], words, strict=False):
                b, f2, f1 = given(before, word)
                cells[b][rounded(f2), rounded(f1)] += 1
    weights, last = {}, (0.0, 0.0, 1.0)
    for b in range(lm.BUCKETS):
        if cells[b]:
            mix = [1 / 3] * 3
            for _ in range(lm.ROUNDS):
                new = [0.0] * 3
                for (f2, f1), n in cells[b].items():
                    joint = [m * p for m, p in zip(mix, (f2, f1, 1 / (len(kinds) + 1)), strict=True)]
                    new = [x + n * j / sum(joint) for x, j in zip(new, joint, strict=True)]
                mix = [x / sum(new) for x in new]
            held = [max(m, 1e-6) for m in mix]
            last = tuple(m / sum(held) for m in held)
            if b == 0:
                last = (0.0, last[1] / (last[1] + last[2]), last[2] / (last[1] + last[2]))
        weights[b] = last
    out = {}
    for i, words in lines.items():
        out[i] = 0.0
        for before, word in zip(["<start>", *words], words, strict=False):
            b, f2, f1 = given(before, word)
            out[i] += math.log10(sum(w * p for w, p in zip(weights[b], (f2, f1, 1 / (len(kinds) + 1)), strict=True)))
    return out, (single, double, total, kinds, weights)


def zipf_texts(seed, n, words=30):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.4, words)) for _ in range(n)]


def test_scores_match_brute_force(spark):
    docs = list(enumerate([*zipf_texts(1, 150), "", "only once", *zipf_texts(1, 20)])) + [(900, None)]
    wanted, (single, double, total, kinds, weights) = brute_model(docs)
    found = {r["doc_id"]: r["score"] for r in scored(frame(spark, [(i, t, "", "", 0) for i, t in docs]))}
    assert found.keys() == wanted.keys() and all(abs(found[i] - wanted[i]) < 1e-6 * max(1, abs(wanted[i])) for i in wanted)
    # What follows one history: all words, the end and one unseen word have a probability of one together.
    history = "w1"
    w = weights[int(math.log2(single[history])) + 1]
    shares = [w[0] * double[history, x] / single[history] + w[1] * single[x] / total + w[2] / (len(kinds) + 1) for x in kinds]
    assert abs(sum(shares) + w[2] / (len(kinds) + 1) - 1) < 1e-9


def test_texts_that_occur_twice_do_not_vouch_for_themselves(spark):
    held_ids, ids = [i for i in range(3000) if brute.crc(i) == 1], [i for i in range(3000) if brute.crc(i) != 1]
    held, texts = zipf_texts(11, 60), zipf_texts(12, 200)
    for copies in (1, 2):
        rows = [(i, t, "", "", 0) for i, t in zip(ids, texts * copies, strict=False)] + [(i, t, "", "", 0) for i, t in zip(held_ids, held, strict=False)]
        out = [r for r in scored(frame(spark, rows)) if r["held_out"]]
        assert len(out) == 60 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out) - 0.02 * sum(r["n_tokens"] for r in out)


def test_weights_by_expectation_maximisation():
    cells = pd.DataFrame({"bucket": [3, 3], "f2": [1 + lm.PER_OCTAVE, 0], "f1": [1 + 4 * lm.PER_OCTAVE, 1 + 4 * lm.PER_OCTAVE], "n": [600.0, 400.0]})
    weights = lm.learn_weights(cells, 1 << 20)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0].tolist() == [0, 0, 1]
    # The likelihood 600 log(a/2 + b/16) + 400 log(b/16) with a + b = 1 is largest at b = 4/10 * 8/7.
    assert abs(weights[3, 1] - 0.4 * 8 / 7) < 1e-2 and weights[30].tolist() == weights[3].tolist()


def test_pipeline_of_odd_rows(spark, odd, none, documents):
    import corpus_pipeline

    for docs in (odd, none, documents):
        now = docs
        for i, (_, step) in enumerate(corpus_pipeline.STAGES):
            now = step(spark, now, SMALL)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == docs.columns
        rows = now.collect()
        assert bool(rows) == bool(docs.count())
    kept = corpus_pipeline.quality_rules(spark, documents, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1")
    good = documents.join(labels, "doc_id", "left_semi")
    lost = [r.text for r in good.join(kept, "doc_id", "left_anti").collect()]
    for text in lost:
        n, *_, repeated = brute.quality(text)
        assert n < 20 or 100 * repeated > 30 * n
