"""Personal data by bootstrapped contextual extraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import GAP, WORD, let, running_starts, stage

# The base kinds in their order. Patterns are those of the definition, written so that a long run of characters is
# tried once: where a run has failed, no start inside it can succeed.
KINDS = ("email", "ip", "card", "phone", "learned")
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"
#: An identifier candidate: a word of at least so many characters with a digit.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
CANDIDATE_CHARS = 6

CONTEXT_CHARS = 128
ROUNDS = 3
#: What a pattern needs: distinct instances that are known, and the share of its weight that they have.
MIN_SEEDS, MIN_PRECISION = 5, 0.9
#: What an instance needs: the mean reliability of the patterns that hold it.
MIN_SCORE = 0.9

TOKENS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "learned": "<ID>"}


def occurrences(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs: start and end in code points, the match, and the text on either side.

    Splitting at the pattern gives what lies between its matches; lengths of both add up to places. The text on a side runs over
    up to two neighbouring matches, so a match close by hides no words.
    """

    def placed(found: Column) -> Column:
        def by_gap(gaps: Column) -> Column:
            lengths = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long"))

            def by_start(starts: Column) -> Column:
                def cut(x: Column, last: bool) -> Column:
                    return F.coalesce((F.right if last else F.left)(x, F.lit(CONTEXT_CHARS)), F.lit(""))

                def side(i: Column, step: int) -> Column:
                    # Gap i lies before match i: going left the nearest piece is last, going right first.
                    last, nearest = step < 0, i if step < 0 else i + 1
                    pieces = [cut(F.get(gaps, nearest), last)]
                    for k in (1, 2):
                        pieces += [cut(F.get(found, i + step * k), last), cut(F.get(gaps, nearest + step * k), last)]
                    return cut(F.concat(*(pieces[::-1] if last else pieces)), last)

                def one(m: Column, i: Column) -> Column:
                    start = (F.get(starts, i) + F.length(F.get(gaps, i))).cast("int")
                    return F.struct(
                        start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"),
                        side(i, -1).alias("left"), side(i, 1).alias("right"),
                    )

                return F.transform(found, one)

            return let(running_starts(lengths), by_start)

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), by_gap))

    return let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass Luhn: from the right, every second one is doubled and its digits added."""

    def one(total: Column, pair: Column) -> Column:
        return total + pair

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    reversed_digits = F.split(F.reverse(digits(value)), "")
    return F.aggregate(F.transform(reversed_digits, worth), F.lit(0), one) % 10 == 0


def base_entities(text: Column) -> dict[str, Column]:
    """The valid matches of each base kind; a cheap test spares most texts the pattern."""
    none = F.lit(None)

    def gated(kind: str, pattern: str, gate: Column, valid) -> Column:
        return F.when(gate, F.filter(occurrences(text, pattern), lambda o: valid(o["value"]))).otherwise(none)

    numeric = F.rlike(text, F.lit("[0-9]"))
    long_run = lambda v: let(F.length(digits(v)), lambda n: (n >= 12) & (n <= 19))
    return {
        "email": gated("email", EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        "ip": gated("ip", IP, numeric, lambda v: F.rlike(v, F.lit(IP_VALID))),
        "card": gated("card", CARD, numeric, lambda v: F.when(long_run(v), luhn(v)).otherwise(False)),
        "phone": gated("phone", PHONE, F.contains(text, F.lit("+")), lambda v: F.length(digits(v)).between(9, 15)),
    }


def _side(text: Column, last: bool) -> Column:
    """The one or two nearest whole words of a context, lower-cased, bare of digits and marks."""
    bare = F.regexp_replace(F.lower(text), r"[0-9]+", "0")
    tokens = F.regexp_extract_all(bare, F.lit(f"({WORD})"), F.lit(1))
    return F.array_join(F.slice(tokens, F.lit(-2), F.lit(2)), " ") if last else F.array_join(F.slice(tokens, F.lit(1), F.lit(2)), " ")


def patterns_of(left: Column, right: Column) -> Column:
    """Lexical patterns: two words before, two words after, and one on either side."""

    def of(sides: Column) -> Column:
        before, after = F.split(sides["l"], " "), F.split(sides["r"], " ")
        both = F.concat_ws(" _ ", F.element_at(before, -1), F.element_at(after, 1))
        two = lambda words, text: F.when(F.size(words) == 2, text)
        return F.array_compact(F.array(
            two(before, F.concat(F.lit("l "), sides["l"])),
            two(after, F.concat(F.lit("r "), sides["r"])),
            F.when((sides["l"] != "") & (sides["r"] != ""), F.concat(F.lit("b "), both)),
        ))

    return let(F.struct(_side(left, True).alias("l"), _side(right, False).alias("r")), of)


OCCURRENCES = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def _all_base() -> Column:
    """Base spans of all kinds in one array, by start, then kind as listed."""

    def ranked(rank: int, kind: str) -> Column:
        own = F.coalesce(F.col(f"of_{kind}"), F.array().cast(OCCURRENCES))
        return F.transform(
            own,
            lambda o: F.struct(
                o["start"].alias("start"), F.lit(rank).alias("rank"), o["end"].alias("end"), F.lit(kind).alias("kind"),
                o["value"].alias("value"), o["left"].alias("left"), o["right"].alias("right"),
            ),
        )

    return F.sort_array(F.concat(*[ranked(i, k) for i, k in enumerate(KINDS[:4])]))


def _shape(value: Column) -> Column:
    """An instance without the marks around it."""
    return F.lower(F.regexp_replace(value, r"^[^0-9A-Za-z+]+|[^0-9A-Za-z]+$", ""))


def reliable(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Iterative scoring of the pattern-instance graph: (instance, score) of instances that are not seeds.

    ``edges`` has one row per distinct (pattern, instance) with ``seed``. A pattern is as reliable as the share of its instances
    that are, if it holds enough of them; an instance as its patterns are on average. Both are partial aggregates over the edges,
    which each round joins on one side only.
    """
    scores = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"), F.max("seed").alias("seed"))
    for _ in range(rounds):
        held = edges.drop("seed").join(scores, "instance")
        graded = held.groupBy("pattern").agg(
            F.avg("score").alias("precision"), F.sum((F.col("score") >= MIN_SCORE).cast("int")).alias("support")
        ).where((F.col("support") >= MIN_SEEDS) & (F.col("precision") >= MIN_PRECISION))
        lifted = edges.drop("seed").join(graded, "pattern").groupBy("instance").agg(F.avg("precision").alias("lift"))
        scores = stage(
            scores.join(lifted, "instance", "left").select(
                "instance", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("lift", F.lit(0.0))).alias("score"), "seed"
            )
        )
    return scores.where(~F.col("seed") & (F.col("score") >= MIN_SCORE)).select("instance", "score")


def extract(docs: DataFrame, keep_columns: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans (kind, start, end) by start, then kind as listed.

    Base entities are the seeds. The words around them become patterns; patterns whose instances are nearly all known, and
    instances that such patterns hold, are found in rounds. An identifier found that way is a ``learned`` span wherever it
    stands outside base spans. Null and empty texts have no spans; rows are told apart by a key of their own, so repeated
    rows and null ids are kept, an empty table stays empty, very long texts are read whole. With ``keep_columns`` all columns of ``docs`` come along, for redaction.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    kinds = base_entities(body)
    source = docs.select(
        F.col("doc_id").alias("__id"), F.monotonically_increasing_id().alias("__row"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all")] if keep_columns else []),
        *[c.alias(f"of_{k}") for k, c in kinds.items()],
        F.coalesce(
            F.when(
                F.rlike(body, F.lit("[0-9]")),
                F.filter(occurrences(body, CANDIDATE), lambda o: F.length(o["value"]) >= CANDIDATE_CHARS),
            ),
            F.array().cast(OCCURRENCES),
        ).alias("__words"),
    )
    rows = stage(source.withColumn("__base", _all_base()).drop(*[f"of_{k}" for k in kinds]))
    base = rows.where(F.size("__base") > 0).select("__row", F.explode("__base").alias("o"))
    outside = F.filter(
        F.col("__words"),
        lambda w: ~F.exists(F.col("__base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])),
    )
    words = rows.where(F.size("__words") > 0).select("__row", F.explode(outside).alias("o"))

    def seen(occ: DataFrame, seed: bool) -> DataFrame:
        return occ.select(
            F.explode(patterns_of(F.col("o.left"), F.col("o.right"))).alias("pattern"), _shape(F.col("o.value")).alias("instance"),
            F.lit(seed).alias("seed"),
        )

    edges = stage(seen(base, True).union(seen(words, False)).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    learned = (
        words.withColumn("instance", _shape(F.col("o.value"))).join(reliable(edges), "instance")
        .groupBy("__row").agg(F.collect_list(F.struct(
            F.col("o.start").alias("start"), F.lit(len(KINDS) - 1).alias("rank"), F.col("o.end").alias("end"), F.lit(KINDS[-1]).alias("kind")
        )).alias("__more"))
    )
    slim = F.transform(
        "__base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    merged = F.transform(
        F.sort_array(F.concat(slim, F.coalesce("__more", none))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    joined = rows.join(learned, "__row", "left")
    if keep_columns:
        return joined.select("__all", merged.alias("__spans"))
    return joined.select(F.col("__id").alias("doc_id"), merged.alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by a mark of its kind; where spans overlap, the first stands. Columns stay.

    A text without spans is returned as it is, null included.
    """
    found = extract(docs, keep_columns=True)
    free = F.aggregate(
        "__spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("kept")),
        lambda a, s: F.when(
            s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["kept"], F.array(s)).alias("kept"))
        ).otherwise(a),
        lambda a: a["kept"],
    )
    mark = lambda kind: F.element_at(F.create_map(*[F.lit(x) for pair in TOKENS.items() for x in pair]), kind)
    text = F.col("__all.text")

    def replaced(kept: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            after = F.coalesce(F.get(kept, i + 1)["start"], F.length(text))
            return F.concat(mark(s["kind"]), F.substring(text, s["end"] + 1, after - s["end"]))

        return F.concat(F.substring(text, F.lit(1), F.get(kept, F.lit(0))["start"]), F.array_join(F.transform(kept, piece), ""))

    new = F.when(F.size("__spans") == 0, text).otherwise(let(free, replaced))
    return found.select(*[new.alias("text") if c == "text" else F.col("__all").getField(c).alias(c) for c in docs.columns])
