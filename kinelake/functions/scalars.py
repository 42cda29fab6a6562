"""Scalar column functions: text keys, times, units, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------------
SLUG_STRIP = "-._"
SLUG_KEEP_PATTERN = "[^a-zA-Z0-9._-]+"
TOKEN_HEX_CHARS = 24
FALSE_WORDS = ("false", "0", "no", "off", "")
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# ------------------------------------------------------------------------------------------------------------------


def slug(col: Column) -> Column:
    """Path-safe id; NULL where nothing is left (callers turn that into an error row)."""
    text = F.btrim(F.regexp_replace(F.trim(col), SLUG_KEEP_PATTERN, "-"), F.lit(SLUG_STRIP))
    return F.nullif(text, F.lit(""))


def identity_token(*cols: Column) -> Column:
    """Stable lineage token of an episode version."""
    joined = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.substring(F.sha2(joined, 256), 1, TOKEN_HEX_CHARS)


def padded(prefix: str, number: Column, digits: int, suffix: str = "") -> Column:
    return F.format_string(f"{prefix}%0{digits}d{suffix}", number.cast("long"))


def episode_path(index: Column) -> Column:
    return padded("episodes/episode-", index, 6)


def to_degrees(col: Column, units: Column) -> Column:
    """Degrees for radian data; any other unit is taken as is."""
    return F.when(F.coalesce(F.nullif(units, F.lit("")), F.lit("radians")).startswith("rad"), F.degrees(col)).otherwise(col)


def clamp(col: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(col, hi))


def first_present(*cols: Column) -> Column:
    """First text that is neither NULL nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def first_nonzero(*cols: Column) -> Column:
    """First number that is neither NULL nor zero."""
    return F.coalesce(*[F.when(c != 0, c) for c in cols])


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def ns_to_seconds(ns: Column) -> Column:
    return ns.cast("double") / F.lit(1e9)


def timestamp_to_ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000)


def duration_seconds(frames: Column, fps: Column) -> Column:
    return frames.cast("double") / F.greatest(F.coalesce(fps, F.lit(1)), F.lit(1)).cast("double")


def flag(col: Column, default: bool) -> Column:
    """Truthiness of a text flag; NULL takes the default."""
    text = F.lower(F.trim(col.cast("string")))
    return F.when(col.isNull(), F.lit(default)).otherwise(~text.isin(*FALSE_WORDS))


def camera_field(name: Column) -> Column:
    """Parts of a ``camera.<name>.<field>`` column name; the field keeps any further dots."""
    parts = F.split(name, r"\.", 3)
    return F.struct(F.get(parts, 1).alias("camera"), F.get(parts, 2).alias("field"))


def age_seconds(captured_ns: Column, now_ns: Column) -> Column:
    """Age of a capture; infinite when the capture time is missing."""
    missing = F.coalesce(captured_ns, F.lit(0)) == 0
    return F.when(missing, F.lit(float("inf"))).otherwise(
        F.greatest(F.lit(0), now_ns - captured_ns).cast("double") / F.lit(1e9)
    )


def two_decimals(col: Column) -> Column:
    """A non-negative number with two decimals, rounded as its binary value lies; ``format_string`` rounds its shortest decimal form.

    The fraction is taken in steps of 2**-56 (2**-60 for small numbers), so hundredths and what is left of them are exact integers.
    """
    whole = F.floor(col)

    def hundredths(bits: int) -> Column:
        steps = ((col - whole) * F.lit(2.0**bits)).cast("long") * F.lit(100)
        cents, rest = F.shiftright(steps, bits), steps.bitwiseAND(F.lit(2**bits - 1))
        half = 2 ** (bits - 1)
        return cents + ((rest > half) | ((rest == half) & (cents % 2 == 1))).cast("long")

    rounded = F.when(col < 0.0625, hundredths(60)).otherwise(hundredths(56))
    exact = F.format_string("%d.%02d", whole + F.floor(rounded / 100), rounded % 100)
    # Above 2**52 there is no fraction.
    return F.when((col >= 0) & (col < 2.0**52), exact).otherwise(F.format_string("%.2f", col))


def stale_detail(captured_ns: Column, age: Column, limit: float) -> Column:
    return F.when(F.coalesce(captured_ns, F.lit(0)) == 0, F.lit("no capture time")).otherwise(
        F.concat(two_decimals(age), F.lit(f"s > {limit:.2f}s"))
    )
