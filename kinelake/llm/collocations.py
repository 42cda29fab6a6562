"""Collocated phrases by relational mining: sorted occurrence relations grow by one word per round, frequent groups only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import LOWER, UPPER
from kinelake.session import shared_folder, stage
from kinelake.sources.commits import remove

LONGEST = 5
SUPPORT = 100
#: A shorter phrase goes where a longer one around it has at least this share of its occurrences, in hundredths.
ABSORBED = 100
TOP = 2000
UNKNOWN = "und"
#: Words of one part of an occurrence relation; a document is never cut, so a longer one is a part of its own.
PART_WORDS = 1 << 22
#: Parts of one file: a reader holds a file's parts at a time.
FILE_PARTS = 4
#: Up to so many frequent groups (some tens of MB) are sent to all workers; more are joined by key and brought back by part.
SENT_GROUPS = 1_000_000

# Where pieces end; blank and tab are what is left between words.
ENDS = ".,;:!?\n\x0b\x0c\r"
BORDER = b"."
FOLD = bytes.maketrans(UPPER.encode() + ENDS.encode(), LOWER.encode() + BORDER * len(ENDS))


class Codes(dict):
    """Numbers of words in order of appearance; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words with a border after each piece, so that words of different pieces never stand side by side."""
    return (text or b"").translate(FOLD).replace(BORDER, b" . ").split() + [BORDER]


def folder(df: DataFrame, before: str | None = None) -> tuple[DataFrame, str]:
    """A written table of few large rows per file, read back, and its folder. The folder ``before``, which nothing reads once this
    table is complete, goes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", FILE_PARTS).parquet(path)
    if before is not None:
        remove(spark, before)
    return spark.read.schema(df.schema).parquet(path), path


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed bytes."""
    return zstandard.compress(numbers.astype(np.int32).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.int32)


# A part of the relation of all words: a number per token, and for each number from 1 its key (language, blank, word) and count.
TOKENS = "part long, codes binary, groups array<struct<key:binary,n:bigint>>"
# A part of the relation of frequent groups: places in rising order, the number of the group that begins at each, and their ids.
OCCURRENCES = "part long, places binary, codes binary, ids array<bigint>"
PAIRS = "part long, left long, right long, n long"


def words_relation(docs: DataFrame) -> DataFrame:
    """Occurrences of all words, in parts that hold whole documents."""

    def part(number: int, held: list[tuple[str, np.ndarray]], known: dict[str, Codes]) -> pa.RecordBatch:
        # Numbers of a language follow those of the one before; borders stay 0.
        base, at, keys = {}, 1, []
        for lang, codes in known.items():
            base[lang], at = at - 1, at + len(codes) - 1
            keys += [lang.encode() + b" " + word for word in list(codes)[1:]]
        flat = np.concatenate([np.where(c > 0, c + base[lang], 0) for lang, c in held]).astype(np.int32)
        counts = np.bincount(flat, minlength=at)[1:]
        groups = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["key", "n"])
        listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), groups)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed(flat)]), listed], names=["part", "codes", "groups"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, held, known, size = TaskContext.get().partitionId(), 0, [], {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = tokens(text.as_py())
                if held and size + len(words) > PART_WORDS:
                    yield part((task << 32) + serial, held, known)
                    serial, held, known, size = serial + 1, [], {}, 0
                codes = known.setdefault(lang, Codes({BORDER: 0}))
                held.append((lang, np.fromiter(map(codes.__getitem__, words), np.int32, len(words))))
                size += len(words)
        if held:
            yield part((task << 32) + serial, held, known)

    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(gather, TOKENS)


def kept(part: int, places: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
    """The semi-join: occurrences whose group has an id (not -1), groups numbered anew."""
    frequent = ids >= 0
    own = frequent[codes]
    if not own.any():
        return None
    renamed = np.cumsum(frequent) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([packed(places[own])]), pa.array([packed(renamed[codes[own]])]), pa.array([ids[frequent]], pa.list_(pa.int64()))],
        names=["part", "places", "codes", "ids"],
    )


def adjacent(places: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """The merge-join of sorted occurrences with themselves on the next place: where each pair begins, the number of the pair, and
    for each number the ids of both halves and its count."""
    first = np.flatnonzero(places[1:] == places[:-1] + 1)
    pairs = codes[first].astype(np.int64) * len(ids) + codes[first + 1]
    distinct, number, count = np.unique(pairs, return_inverse=True, return_counts=True)
    return places[first], number, ids[distinct // max(len(ids), 1)], ids[distinct % max(len(ids), 1)], count


def occurrences(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpacked(row["places"]), unpacked(row["codes"]), np.array(row["ids"], np.int64)


def pairs_of(relation: DataFrame) -> DataFrame:
    """Distinct pairs of neighbours of each part, with how often they occur there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, left, right, n = adjacent(*occurrences(row))
                columns = [np.full(len(n), row["part"]), left, right, n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "left", "right", "n"])

    return relation.mapInArrow(count, PAIRS)


def frequent_words(relation: DataFrame, frequent: DataFrame, sent: bool) -> DataFrame:
    """Occurrences of the frequent words. ``frequent``: ``key, id``."""

    def ids_of(row: dict, ids: np.ndarray) -> pa.RecordBatch | None:
        codes = unpacked(row["codes"])
        places = np.flatnonzero(codes)
        return kept(row["part"], places, codes[places] - 1, ids)

    if sent:
        table = frequent.toArrow()
        held = relation.sparkSession.sparkContext.broadcast((table.column("key").combine_chunks(), table.column("id").to_numpy()))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, ids = held.value
            ids = np.append(ids, -1)
            for batch in batches:
                for i, row in enumerate(batch.select(["part", "codes"]).to_pylist()):
                    found = pc.index_in(batch.column("groups")[i].values.field("key"), value_set=keys)
                    out = ids_of(row, ids[pc.fill_null(found, -1).to_numpy(zero_copy_only=False)])
                    if out is not None:
                        yield out

        return relation.mapInArrow(look, OCCURRENCES)

    def meet(own: pa.Table, known: pa.Table) -> pa.Table:
        out = None
        if own.num_rows:
            ids = np.full(own.column("many")[0].as_py(), -1, np.int64)
            ids[known.column("code").to_numpy()] = known.column("id").to_numpy()
            out = ids_of(own.select(["part", "codes"]).to_pylist()[0], ids)
        return pa.Table.from_batches([out] if out is not None else [], schema=None if out is not None else _NONE)

    groups = relation.select(F.col("part").alias("of"), F.posexplode("groups").alias("code", "g")).select("of", "code", "g.key")
    known = groups.join(frequent, "key").select("of", "code", "id")
    slim = relation.select("part", "codes", F.size("groups").alias("many"))
    return slim.groupBy("part").cogroup(known.groupBy("of")).applyInArrow(meet, OCCURRENCES)


_NONE = pa.schema([("part", pa.int64()), ("places", pa.binary()), ("codes", pa.binary()), ("ids", pa.list_(pa.int64()))])


def frequent_pairs(relation: DataFrame, frequent: DataFrame, sent: bool) -> DataFrame:
    """Occurrences of the frequent pairs. ``frequent``: ``left, right, id``."""

    def grown(row: dict, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch | None:
        places, number, left, right, _ = adjacent(*occurrences(row))
        return kept(row["part"], places, number, lookup(left, right, known)) if len(number) else None

    if sent:
        held = relation.sparkSession.sparkContext.broadcast(by_halves(frequent.toArrow()))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    if (out := grown(row, held.value)) is not None:
                        yield out

        return relation.mapInArrow(look, OCCURRENCES)

    def meet(own: pa.Table, known: pa.Table) -> pa.Table:
        out = grown(own.to_pylist()[0], by_halves(known)) if own.num_rows else None
        return pa.Table.from_batches([out] if out is not None else [], schema=None if out is not None else _NONE)

    known = pairs_of(relation).join(frequent, ["left", "right"]).select(F.col("part").alias("of"), "left", "right", "id")
    return relation.groupBy("part").cogroup(known.groupBy("of")).applyInArrow(meet, OCCURRENCES)


def by_halves(known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and their ids in the order of the pairs."""
    left, right, ids = (known.column(c).to_numpy() for c in ("left", "right", "id"))
    order = np.lexsort((right, left))
    return left[order], right[order], ids[order]


def lookup(left: np.ndarray, right: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of pairs, -1 where unknown. Ids of halves are renumbered so that a pair is one number that can be searched."""
    lefts, rights, ids = known
    if not len(ids):
        return np.full(len(left), -1, np.int64)
    names, others = np.unique(lefts), np.unique(rights)
    place = lambda values, among: np.minimum(np.searchsorted(among, values), len(among) - 1)
    a, b = place(left, names), place(right, others)
    asked = a * len(others) + b
    held = place(lefts, names) * len(others) + place(rights, others)
    at = place(asked, held)
    return np.where((held[at] == asked) & (names[a] == left) & (others[b] == right), ids[at], -1)


def mine(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, absorbed: int = ABSORBED, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of each language (null: ``und``): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``ENDS``; phrases are 2 to ``longest`` words of a piece with ``support`` or
    more occurrences a. Of all ways to cut a phrase in two, with l and r the occurrences of its parts and n the words of the
    language, the least floor(1000 * a * n / (l * r)) is its score. A phrase inside a longer one with at least ``absorbed``
    hundredths of its occurrences is left out. Null and empty texts have no words; repeated rows count each time; null ids and
    further columns do not matter; an empty table gives no rows. A very long text is one part of the relation.

    Every relation is written, sorted by place, in parts of whole documents; borders between pieces take a place, so adjacent
    places are adjacent words of one piece. A round joins each part with itself on the next place, counts the groups over all
    parts, and keeps (semi-join) the occurrences of frequent groups before the next round: both halves of a longer frequent phrase
    are frequent. Shuffles move one row per part and distinct group, not per occurrence. A relation goes when the next is written.
    """
    relation, place = folder(words_relation(docs))
    counts = stage(relation.select(F.explode("groups").alias("g")).groupBy("g.key").agg(F.sum("g.n").alias("a")))
    # A word holds no blank, so the last one ends the language.
    word = F.element_at(F.split(F.col("key").cast("string"), " "), -1)
    lang = F.col("key").cast("string").substr(F.lit(1), F.char_length(F.col("key").cast("string")) - F.char_length(word) - 1)
    total = counts.groupBy(lang.alias("lang")).agg(F.sum("a").alias("n"))
    found = [stage(counts.where(F.col("a") >= support).select(F.monotonically_increasing_id().alias("id"), lang.alias("lang"), word.alias("phrase"), "a", "key"))]
    for length in range(2, longest + 1):
        before = found[-1]
        many = before.count()
        if not many:
            break
        grow, key = (frequent_words, ["key"]) if length == 2 else (frequent_pairs, ["left", "right"])
        relation, place = folder(grow(relation, before.select(*key, "id"), many <= SENT_GROUPS), place)
        frequent = pairs_of(relation).groupBy("left", "right").agg(F.sum("n").alias("a")).where(F.col("a") >= support)
        # The words of a phrase are its first part's words and the last word of its second part.
        first = before.select(F.col("id").alias("left"), "lang", "phrase")
        last = before.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("last"))
        named = frequent.join(first, "left").join(last, "right").withColumn("phrase", F.concat_ws(" ", "phrase", "last"))
        found.append(stage(named.select(F.monotonically_increasing_id().alias("id"), "lang", "phrase", "a", "left", "right")))
    remove(docs.sparkSession, place)
    return _ranked(found, total, absorbed, top)


def _ranked(found: list[DataFrame], total: DataFrame, absorbed: int, top: int) -> DataFrame:
    """Score the frequent phrases of two words or more and keep the best of each language."""
    every, phrases, inside = None, None, None
    for length, level in enumerate(found, 1):
        named = level.select("lang", "phrase", "a")
        every = named if every is None else every.union(named)
        if length > 1:
            own = level.select("lang", "phrase", "a", F.lit(length).alias("words"))
            phrases = own if phrases is None else phrases.union(own)
        if length > 2:
            words = F.split("phrase", " ")
            around = level.select("lang", "a", F.explode(F.array(_join(words, 1, length - 1), _join(words, 2, length - 1))).alias("phrase"))
            inside = around if inside is None else inside.union(around)
    if phrases is None:
        return found[0].sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    if inside is not None:
        # Occurrences fall as phrases grow, so the next longer ones decide.
        most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        phrases = phrases.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True))).drop("longer")
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "a", "words", cut)
    cuts = cuts.select("lang", "phrase", "a", "k", _join(words, 1, F.col("k")).alias("head"), _join(words, F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    heads = every.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = every.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(total, "lang")
    score = F.expr("(CAST(1000 * a AS DECIMAL(20, 0)) * CAST(n AS DECIMAL(18, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")
    scored = scored.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def _join(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start if isinstance(start, Column) else F.lit(start), length if isinstance(length, Column) else F.lit(length)), " ")


def _level_sql(length: int) -> str:
    return f"""SELECT lang, {length} AS words, p AS phrase, count(*) AS a FROM (
        SELECT lang, unnest([array_to_string(ws[i : i + {length - 1}], ' ') FOR i IN range(1, len(ws) - {length - 2})]) AS p FROM pw WHERE len(ws) >= {length}
    ) GROUP BY lang, p HAVING count(*) >= {SUPPORT}"""


MINE_SQL = rf"""
WITH pc AS (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), pw AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS ws FROM pc),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pw GROUP BY lang),
f AS ({" UNION ALL ".join(_level_sql(k) for k in range(1, LONGEST + 1))}),
w AS (SELECT *, string_split(phrase, ' ') AS ws FROM f),
gone AS (
    SELECT DISTINCT s.lang, s.phrase FROM f s JOIN (
        SELECT lang, a, words - 1 AS words, unnest([array_to_string(ws[1 : words - 1], ' '), array_to_string(ws[2 : words], ' ')]) AS phrase FROM w WHERE words > 2
    ) g ON g.lang = s.lang AND g.phrase = s.phrase AND 100 * g.a >= {ABSORBED} * s.a
), cuts AS (
    SELECT lang, phrase, a, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 : words], ' ') AS tail
    FROM (SELECT *, unnest(range(1, words)) AS k FROM w WHERE words > 1)
), s AS (
    SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, k, CAST((CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail JOIN n ON n.lang = c.lang
    WHERE (c.lang, c.phrase) NOT IN (SELECT (lang, phrase) FROM gone)
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s QUALIFY rank <= {TOP}
"""
