"""Quality rules, mixing, near duplicates."""

import brute
import numpy as np
from conftest import CLASHING, ROWS, frame
from pyspark.sql import functions as F

from kinelake.llm import dedup, mixing, quality

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs):
    return [(r.doc_id, r.text, r.q) for r in quality.judge(docs, into="q").select("doc_id", "text", "q").collect()]


def test_quality_matches_brute_force(documents):
    for _, text, q in judged(documents):
        expected = brute.quality(text)
        assert tuple(q[f] for f in FIELDS) == expected
        failed = expected[0] < 20 or 100 * expected[4] > 30 * expected[0]
        assert q.base_failed == failed and not (failed and q.kept)


def test_quality_of_odd_rows(spark, odd, none):
    rows = judged(odd)
    assert len(rows) == len(ROWS)
    for _, text, q in rows:
        assert tuple(q[f] for f in FIELDS) == brute.quality(text)
    assert not judged(none)
    assert quality.judge(odd, into="quality").columns == odd.columns  # replaced, not added


def test_repeats_cover_overlapping_windows(spark):
    texts = ["a b c d e f g h " * 2, "a " * 9, "a " * 8, "p a b c d e f g h q a b c d e f g h r", "one\none\n\n \none\ntwo"]
    for _, text, q in judged(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])):
        assert tuple(q[f] for f in FIELDS) == brute.quality(text)


def mixed(docs):
    return [r.asDict() for r in mixing.mix(docs).collect()]


def test_mix_meets_targets(documents):
    rows = mixed(documents)
    sizes = {r["source"]: r["source_size"] for r in rows}
    names = sorted(sizes)
    total, weight = sum(sizes.values()), {s: 1 + i % 3 for i, s in enumerate(names)}
    for source in names:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["size"] for r in own) == sizes[source]
        target = own[0]["target"]
        assert target <= 3 * sizes[source] + 1e-6
        assert abs(sum(r["taken"] for r in own) - target) <= max(1.0, 0.02 * target)  # sources of ten documents meet no better sum
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    free = [s for s in names if 3 * sizes[s] - next(r["target"] for r in rows if r["source"] == s) > 1e-6]
    per = {round(next(r["target"] for r in rows if r["source"] == s) / weight[s], 3) for s in free}
    assert len(per) == 1 and abs(sum({r["source"]: r["target"] for r in rows}.values()) - total) < 1e-3
    assert rows == mixed(documents.repartition(5)) or sorted(map(str, rows)) == sorted(map(str, mixed(documents.repartition(5))))


def test_mix_of_odd_rows(spark, odd, none):
    rows = mixed(odd)
    assert len(rows) == len(ROWS) and not mixed(none)
    assert {r["doc_id"]: r["size"] for r in rows}[3] == 0
    assert {r["source"] for r in rows} == {"a", "b", "é", None}
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.apply_mix(none).count() == 0


def test_many_equal_lengths_are_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    docs = frame(spark, [(i, f"w{i} and four more words", "en", "ab"[i % 3 == 0], 0) for i in range(90)])
    rows = mixed(docs)
    for source in "ab":
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 5


def test_knapsack_is_best_below_budget():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 30, 6))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        taken = mixing.fit_budget(lengths, counts, budget)
        assert ((0 <= taken) & (taken <= counts)).all()
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * i for s in sums for i in range(c + 1)}
        best = max(s for s in sums if s <= budget)
        assert int((taken * lengths).sum()) == best  # budgets within the reserve are met as well as can be


def grouped(docs, size=4):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(docs, size).collect()]


def test_near_duplicates_match_brute_force(documents):
    expected = brute.near_duplicates([(r.doc_id, r.text) for r in documents.collect()], 4)
    rows = grouped(documents)
    assert len(rows) == documents.count()
    for doc, n, component, kept in rows:
        assert (n, component, kept) == (*expected[doc], doc == component)


def chain(n, words=60, step=3):
    """Texts of which each shares most with the next, but the ends share little."""
    base = [f"w{i}" for i in range(words + step * n)]
    return [" ".join(base[i * step : i * step + words]) for i in range(n)]


def test_chains_and_stars_are_linked_whole(spark):
    texts = [t for t in chain(40)] + [" ".join(f"v{j if j != i else 'x'}" for j in range(120)) for i in range(60)]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    expected = brute.near_duplicates([(d[0], d[1]) for d in docs], 4)
    assert {d: c for d, _, c, _ in grouped(frame(spark, docs))} == {d: c for d, (_, c) in expected.items()}
    assert len(set(c for _, c in expected.values())) < 30


def test_near_duplicates_of_odd_rows(odd, none):
    rows = grouped(odd)
    assert len(rows) == len(ROWS) and not grouped(none)
    by_id = {r[0]: r for r in rows}
    assert by_id[2][2] == 1 and by_id[3] == (3, 0, 3, True) and by_id[5] == (5, 0, 5, True)
    assert by_id[None][2] is None and by_id[None][3]
    left = dedup.drop_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 4, 5, 7, 8, 9, 10]
    assert dedup.drop_duplicates(none).count() == 0


def test_one_id_with_several_texts_is_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = grouped(frame(spark, [(5, a, "", "", 0), (5, b, "", "", 0), (3, a, "", "", 0), (7, b, "", "", 0)]))
    assert {r[2] for r in rows} == {3}


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(3)
    masks, factors, _ = dedup._constants()
    for share in (0.0, 0.5, 0.8, 1.0):
        common, rest = rng.integers(0, 1 << 63, 1000, np.uint64), rng.integers(0, 1 << 63, (2, 1000), np.uint64)
        n = int(1000 * share)
        sides = [dedup.minima(np.concatenate([common[:n], r[n:]]), masks, factors) for r in rest]
        bits = [dedup.packed_bits(m[None])[0] for m in sides]
        differing = [int(x ^ y) for x, y in zip(*bits, strict=True)]
        equal = sum(32 - bin((d | d >> 1) & 0x5555555555555555).count("1") for d in differing) / dedup.HASHES
        assert abs((equal - 0.25) / 0.75 - n / (2000 - n)) < 0.2


def test_columns_of_the_same_names_pass(odd):
    assert set(CLASHING) <= set(odd.columns)
    assert odd.where(F.col("kept") != "other").count() == 0


def test_a_damaged_dictionary_is_one_error_row(spark):
    from kinelake.llm import warc

    content = warc.build_archive([warc.encode_record(i, "http://a", b"x" * 300, "0" * 64, None) for i in range(3)])
    length = int.from_bytes(content[4:8], "little")
    flipped = bytearray(content)
    flipped[8 + length // 2] ^= 0xFF
    for broken in (content[:6], content[: 8 + length // 2], bytes(flipped)):
        rows = list(warc.read_archive(broken))
        assert len(rows) == 1 and rows[0]["error"].startswith("dictionary") and rows[0]["page_id"] is None
    assert list(warc.read_archive(content[: 8 + length])) == [] and list(warc.read_archive(b"")) == []
    damaged = spark.createDataFrame([("a", bytes(flipped)), ("b", content[:6]), ("c", None)], "archive string, content binary")
    assert {(r.archive, r.position) for r in warc.read_archives(damaged).collect()} == {("a", 0), ("b", 0)}
