"""Phrase collocations, hard negatives and near-duplicate embeddings against plain Python."""

import collections
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from conftest import ROWS, SMALL, frame
from pyspark.sql import functions as F

from kinelake.llm import collocations, hard_negatives, near_vectors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- phrases ---------------------------------------------------------------------------------------------------------


def brute_phrases(docs, support, longest=5, absorbed=100, top=2000):
    """docs: (lang, text)."""
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in often.items():
            inside = any(
                len(q) > len(p) and 100 * b >= absorbed * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in often.items()
            )
            if inside:
                continue
            score, k = min((math.floor(Fraction(1000 * a * totals[lang], f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("absorbed, top, part_words, sent", [(100, 2000, 1 << 20, 10**6), (70, 5, 200, 0)])
def test_phrases_match_brute_force(spark, monkeypatch, absorbed, top, part_words, sent):
    monkeypatch.setattr(collocations, "PART_WORDS", part_words)
    monkeypatch.setattr(collocations, "SENT_GROUPS", sent)
    rng = np.random.default_rng(1)
    vocabulary = np.array("a b c A-1 the é x y ▁ THE".split())
    texts = []
    for _ in range(60):
        words = vocabulary[rng.choice(len(vocabulary), 40, p=[0.25, 0.2, 0.1, 0.05, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])]
        glue = rng.choice([" ", "\t ", ". ", ",", "\n", "\x0b", " ; "], 40, p=[0.6, 0.15, 0.05, 0.05, 0.05, 0.05, 0.05])
        texts.append("".join(x for pair in zip(words, glue, strict=True) for x in pair))
    rows = [(i, t, [None, "en", "de"][i % 3], "s", 1) for i, t in enumerate(texts)] + [(1, texts[1], "en", "s", 1), (None, texts[2], "en", None, None)]
    rows += [(90, None, "en", "s", 1), (91, "", "fr", "s", 0), (92, " .,\n\t ", "it", "s", 3)]
    found = phrases(collocations.mine(frame(spark, rows).repartition(3), support=7, absorbed=absorbed, top=top))
    assert found == brute_phrases([(r[2], r[1]) for r in rows], 7, absorbed=absorbed, top=top)
    assert len({r[0] for r in found}) == 3 and any(" a a " in f" {r[2]} " for r in found)


def test_phrases_of_odd_rows(spark, odd, none):
    # A text of 160,000 words is one part of the relation.
    assert phrases(collocations.mine(odd, support=50)) == brute_phrases([(r[2], r[1]) for r in ROWS], 50)
    assert phrases(collocations.mine(odd, support=10**6)) == []
    assert phrases(collocations.mine(none)) == []


# --- hard negatives --------------------------------------------------------------------------------------------------


def brute_negatives(rows, every=100, positives=5, negatives=5, low=80, high=100):
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own[i] = min(own.get(i, (label, v)), (label, v))
    q = {i: (label, [math.floor(Fraction(x) * 256) for x in v]) for i, (label, v) in own.items()}
    out = []
    for a in sorted(i for i in q if i % every == 0):
        score = {i: sum(x * y for x, y in zip(q[a][1], v, strict=False)) for i, (_, v) in q.items() if i != a}
        score = {i: max(min(s, 2**63 - 1), -(2**63)) for i, s in score.items()}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if q[i][0] == q[a][0]][:positives]:
            good = [i for i in order if q[i][0] != q[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]][:negatives]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(good, 1)]
    return sorted(out)


def negatives(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


SCHEMA = "vec_id long, label int, embedding array<double>, id string, v string, a string, c string, node string, x string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *"123456") for r in rows], SCHEMA)


@pytest.mark.parametrize("anchors, candidates, strip, scale", [(2048, 16384, 128, 1.0), (3, 40, 2, 1.0), (7, 60, 128, 1e7), (7, 60, 128, 1e14)])
def test_negatives_match_brute_force(spark, monkeypatch, anchors, candidates, strip, scale):
    for name, value in (("ANCHORS", anchors), ("CANDIDATES", candidates), ("STRIP", strip)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(2)
    # Coarse values make ties; large ones need more than 64 bits.
    rows = [(int(i), int(rng.integers(3)), [float(x) for x in np.round(rng.normal(1, 1, 9), 1) * scale]) for i in range(150)]
    rows += [rows[10], (20, 0, rows[3][2]), (500, None, rows[0][2]), (None, 1, rows[0][2]), (501, 1, None), (502, 1, [None] * 9)]
    rows += [(503, 1, [math.nan] * 9), (504, 1, [math.inf] * 9), (505, 1, []), (510, 2, [0.5]), (-10, 1, rows[5][2]), (511, 1, [0.0] * 9)]
    found = negatives(hard_negatives.mine(table(spark, rows), every=10))
    assert found == brute_negatives(rows, every=10) and found


def test_negatives_of_equal_rows_and_empty_tables(spark):
    rows = [(i, i % 2, [0.5, 0.25]) for i in range(60)]
    assert negatives(hard_negatives.mine(table(spark, rows), every=20)) == brute_negatives(rows, every=20)
    assert negatives(hard_negatives.mine(table(spark, rows).limit(0))) == []
    assert negatives(hard_negatives.mine(table(spark, rows).where("vec_id % 100 <> 0"))) == []


def test_packed_products_are_exact():
    rng = np.random.default_rng(3)
    for reach in (1, 200, 10**6, 10**12):
        a, c = (rng.integers(-reach, reach + 1, (n, 16)) for n in (5, 23))
        wanted = np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in c] for r in a], dtype=object)
        assert (hard_negatives.Products(c, a).of(a) == np.clip(wanted, -(2**63), 2**63 - 1)).all()
    assert hard_negatives.Products(np.zeros((3, 4), np.int64), np.zeros((1, 4), np.int64)).fields > 1


# --- near-duplicate embeddings ---------------------------------------------------------------------------------------


def brute_near(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) for each row, sorted."""
    good = []
    for k, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append(k)
    links, parent = collections.Counter(), {i: i for i, _, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = {k: np.array(rows[k][2]) / np.abs(rows[k][2]).max() for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    for n, x in enumerate(good):
        for y in good[:n]:
            if rows[x][1] == rows[y][1] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= cosine:
                links[x] += 1
                links[y] += 1
                a, b = find(rows[x][0]), find(rows[y][0])
                parent[max(a, b)] = min(a, b)
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted([(i, links[k], None if i is None else find(i), i is None or find(i) == i) for k, (i, _, _) in enumerate(rows)], key=key)


def near(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("cell, width", [(2048, 64), (12, 64), (12, 20), (4, 3), (12, 1)])
def test_near_vectors_match_brute_force(spark, monkeypatch, cell, width):
    monkeypatch.setattr(near_vectors, "CELL", cell)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        center, spread = rng.normal(size=width), [0.02, 0.08, 0.12][c % 3]
        for _ in range(40 if c == 0 else 9):
            v = center / np.linalg.norm(center) + rng.normal(size=width) * spread / math.sqrt(width)
            rows.append((len(rows), c % 4, [float(x) for x in v * 10.0 ** rng.integers(-3, 4)]))
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 90, 3)] + [(2000, rows[5][1] + 1, rows[5][2]), rows[7], (7, rows[60][1], rows[60][2])]
    rows += [(3000, 1, [0.0] * width), (3001, 1, None), (3002, 1, []), (3003, None, rows[0][2]), (None, 1, rows[0][2]), (3004, 1, [math.nan] * width)]
    rows += [(3005, 1, [math.inf] * width), (3006, 1, [None] * width), (3007, 0, [*rows[0][2], 0.0]), (8, None, None), (3008, 0, [1e-300] * width), (3009, 0, [1e300] * width)]
    rng.shuffle(rows)
    rows = [(None if i is None else int(i), None if k is None else int(k), v) for i, k, v in rows]
    assert near(near_vectors.near_vectors(table(spark, rows).repartition(3))) == brute_near(rows)


def test_near_vectors_of_the_given_table_and_of_none(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    close = rows.where("vec_id < 40").select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda x: x * F.lit(1.001).cast("float")).alias("embedding"), "label")
    both = rows.unionByName(close)
    plain = [(r.vec_id, r.label, list(map(float, r.embedding))) for r in both.collect()]
    assert near(near_vectors.near_vectors(both)) == brute_near(plain)
    assert near(near_vectors.near_vectors(rows.limit(0))) == []


def test_a_pair_within_the_distance_keeps_the_budget_of_a_block():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 24))
    b = a + rng.normal(size=(200, 24)) * 0.2
    x, y = near_vectors.unit(a), near_vectors.unit(b)
    assert np.allclose((near_vectors.turned(x) ** 2).sum(axis=0), 1)
    gaps = (near_vectors.turned(x) - near_vectors.turned(y)) ** 2
    within = np.array([gaps[s:e].sum(axis=0) <= limit for (s, e), limit in zip(near_vectors.blocks(32), near_vectors.budgets(32, 0.98), strict=True)])
    assert within.any(axis=0)[(x * y).sum(axis=0) >= 0.98].all() and ((x * y).sum(axis=0) >= 0.98).any()
