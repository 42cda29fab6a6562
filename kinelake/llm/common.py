"""What the corpus operators share: words, document parts by checksum, staged tables, digests of spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.session import stage

# White space is blank and the five controls from tab to carriage return; all else belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = [
    "GAP", "LOWER", "SPACES", "UPPER", "WORD", "ascii_lower", "fold", "let", "read", "running_starts", "span_digest", "span_list",
    "stage", "words",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a lambda variable, so that ``body`` may use it often although it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; none for an empty or null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = str.maketrans(UPPER, LOWER)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(parts))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of spans that are in order already, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def span_digest(spans: Column) -> Column:
    return F.sha2(span_list(spans), 256)


RUN = 256


def running_starts(lengths: Column) -> Column:
    """Sum of all earlier lengths for each entry, in blocks, so that the work stays far from the square of the count."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocks(n: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.ceil(n / F.lit(RUN)).cast("int") - 1, F.lit(0)))

    return let(
        lengths,
        lambda ls: let(
            F.transform(blocks(F.size(ls)), lambda b: total(F.slice(ls, b * RUN + 1, F.lit(RUN)))),
            lambda sums: F.flatten(
                F.transform(
                    blocks(F.size(ls)),
                    lambda b: let(
                        total(F.slice(sums, F.lit(1), b)),
                        lambda base: let(
                            F.slice(ls, b * RUN + 1, F.lit(RUN)),
                            lambda part: F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i))),
                        ),
                    ),
                )
            ),
        ),
    )
