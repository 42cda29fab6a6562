"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import let, words

# The commonest function words of the four languages.
STOP_WORDS = (
    "the of and to in is it that for was with as be by this on a an are or at from "
    "der die das und den von zu mit des im ein eine nicht auf ist sich "
    "de la que el en y los las del se un una por con su para es no "
    "le les et est dans qui par pour au sur pas du"
).split()
SYMBOLS = "[#*$%&|<>]"
WINDOW_WORDS = 8


class Rule(NamedTuple):
    """A measure must lie within its bounds (None: open on that side)."""

    measure: str
    least: float | None
    most: float | None


#: Ratios of a text. Words shorter than two or longer than twelve characters on average are no prose; running text of
#: the four languages has far more than three stop words in a hundred; repeated lines, marks and shouting are junk.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("exclamations_per_word", None, 0.5),
    Rule("stop_word_share", 0.03, None),
    Rule("duplicate_line_share", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def repeated_words(tokens: Column) -> Column:
    """Words inside windows of eight words that occur at least twice in the text, the first occurrence included.

    Hashes of windows grow by doubling (two, four, eight words). A text whose four-word hashes or
    eight-word hashes all differ has no repeats; otherwise the eight-word hashes are sorted, and equal neighbours repeat.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            places, start,
            lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW_WORDS), p - a["last"])).alias("total")),
            lambda a: a["total"],
        )

    def repeats(ordered: Column) -> Column:
        def again(e: Column, i: Column) -> Column:
            before, after = F.get(ordered, i - 1)["h"], F.get(ordered, i + 1)["h"]
            return F.coalesce(before == e["h"], F.lit(False)) | F.coalesce(after == e["h"], F.lit(False))

        return covered(F.sort_array(F.transform(F.filter(ordered, again), lambda e: e["i"])))

    def joined(hashes: Column, step: int) -> Column:
        n = F.size(hashes) - step
        return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))

    def differ(hashes: Column) -> Column:
        return F.size(F.array_distinct(hashes)) == F.size(hashes)

    def from_eights(eights: Column) -> Column:
        pairs = F.sort_array(F.transform(eights, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(differ(eights), F.lit(0)).otherwise(let(pairs, repeats))

    def from_fours(fours: Column) -> Column:
        return F.when(differ(fours), F.lit(0)).otherwise(let(joined(fours, 4), from_eights))

    def of(hashed: Column) -> Column:
        fours = let(joined(hashed, 1), lambda twos: joined(twos, 2))
        return F.when(F.size(hashed) <= WINDOW_WORDS, F.lit(0)).otherwise(let(fours, from_fours))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def measures(text: Column) -> Column:
    """All counts and ratios of a text as one struct. Null and empty texts have no words; every count is 0 there."""
    body = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

    def ratios(c: Column) -> Column:
        n = F.greatest(c["n_words"], F.lit(1)).cast("double")
        return F.struct(
            c["n_words"].cast("long").alias("n_words"),
            c["word_chars"].cast("long").alias("word_chars"),
            c["n_symbols"].cast("long").alias("n_symbols"),
            c["lines"]["dup"].cast("long").alias("n_dup_lines"),
            c["n_repeat_words"].cast("long").alias("n_repeat_words"),
            (c["word_chars"] / n).alias("mean_word_chars"),
            (c["n_symbols"] / n).alias("symbols_per_word"),
            (c["n_bangs"] / n).alias("exclamations_per_word"),
            (c["n_stops"] / n).alias("stop_word_share"),
            (c["lines"]["dup"] / F.greatest(c["lines"]["n"], F.lit(1))).alias("duplicate_line_share"),
        )

    def of_words(tokens: Column) -> Column:
        has_word = F.filter(F.split(body, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
        return let(
            F.struct(
                F.size(tokens).alias("n_words"),
                F.length(F.array_join(tokens, "")).alias("word_chars"),
                F.regexp_count(body, F.lit(SYMBOLS)).alias("n_symbols"),
                (F.length(body) - F.length(F.replace(body, F.lit("!")))).alias("n_bangs"),
                F.size(F.filter(tokens, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stops"),
                let(has_word, of_lines).alias("lines"),
                repeated_words(tokens).alias("n_repeat_words"),
            ),
            ratios,
        )

    return let(words(text), of_words)


def verdict(m: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The rule table as one boolean expression."""
    held = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            held = held & (m[rule.measure] >= F.lit(rule.least))
        if rule.most is not None:
            held = held & (m[rule.measure] <= F.lit(rule.most))
    return held


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def keeps(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The verdict of ``judge`` alone. Its measures are bound once, so a filter evaluates them once however many rules read them."""
    return let(measures(text), lambda m: F.when(base_failed(m), F.lit(False)).otherwise(verdict(m, rules)))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, into: str = "quality") -> DataFrame:
    """Every row with a struct column of its measures, ``base_failed`` and ``kept``.

    A null or empty text fails the base rules (fewer than twenty words). Rows are judged one by one: equal rows get equal
    verdicts, an empty table stays empty, further columns pass through (one named like ``into`` is replaced).
    """
    judged = docs.withColumn(into, measures(F.col("text")))
    m = F.col(into)
    failed = base_failed(m)
    return judged.withColumn(
        into, m.withField("base_failed", failed).withField("kept", F.when(failed, F.lit(False)).otherwise(verdict(m, rules)))
    )
