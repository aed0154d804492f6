"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Base measures are counted inside each row.  A sketch is a histogram over log-linear buckets (five
leading bits after the first are kept, so bucket values are at most 1/32 too low).  Sketches merge
by adding counts, in any order and with partial sums before each shuffle, and are the same on every
run.  Fences are quartiles plus a multiple of their distance; sources with few documents take the
merged sketch of their language.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import BLANKS, stored, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, REPEAT_PERCENT = 10, 20
#: Fence beyond the quartiles, in quartile distances.
REACH = 3
#: Documents a source needs for thresholds of its own.
LEAST_GROUP = 50
#: Measure: (numerator, units per word, least quartile distance in these units, fence below too).
MEASURES = {
    "symbols": ("n_symbols", 1000, 100, False),
    "word_length": ("word_chars", 100, 100, True),
    "dup_lines": ("n_dup_lines", 1000, 50, False),
    "repeats": ("n_repeat_words", 1000, 60, False),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value worked out once, also where lambdas inside use it."""
    return F.transform(F.array(value), fn)[0]


def _covered(windows: Column) -> Column:
    """Words under windows that occur twice or more; ``windows`` are hashes by position."""
    spread = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"] == x["h"], F.get(s, k + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        bind(spread, twins),
        start,
        lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")
        ),
        lambda a: a["n"],
    )


def repeat_words(tokens: Column) -> Column:
    """Words in five-word windows found twice or more.  Windows are compared by 64-bit hashes; a
    text has no repeats when all are distinct, which is most texts, so only others are sorted."""

    def over(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        )

    def count(windows: Column) -> Column:
        distinct = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(distinct, F.lit(0)).otherwise(_covered(windows))

    def whole(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(bind(bind(hashes, over), count))

    return bind(tokens, whole).cast("long")


def dup_lines(text: Column) -> Column:
    def count(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return bind(lines, count).cast("long")


def measure(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``__row`` with the columns to carry (all of ``df``), then the base measures; null texts count as empty."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    counted = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("__row"),
        F.regexp_count(body, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("n_words"),
        F.length(F.translate(body, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(body).alias("n_dup_lines"),
        repeat_words(words(body)).alias("n_repeat_words"),
    )
    few = F.col("n_words") < LEAST_WORDS
    loops = 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    return counted.withColumn("base_failed", few | loops)


def _scaled(name: str) -> Column:
    over, units, _, _ = MEASURES[name]
    return F.when(F.col("n_words") > 0, F.floor(units * F.col(over) / F.col("n_words"))).otherwise(0).cast("long")


def bucket(value: Column) -> Column:
    """The least value of the bucket: all but the six leading bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts per language, source, measure and bucket."""
    cells = [F.struct(F.lit(m).alias("m"), bucket(_scaled(m)).alias("v")) for m in MEASURES]
    flat = measured.where(~F.col("base_failed")).select(
        F.col(f"__row.`{lang}`").alias("lang"), F.col(f"__row.`{source}`").alias("source"), F.array(*cells).alias("cells")
    )
    # One group per distinct tuple of buckets first: four times fewer rows reach the hash table.
    packed = flat.groupBy("lang", "source", "cells").agg(F.count(F.lit(1)).alias("n"))
    return (
        packed.select("lang", "source", F.explode("cells").alias("c"), "n")
        .groupBy("lang", "source", "c.m", "c.v")
        .agg(F.sum("n").alias("n"))
    )


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys`` with the number of documents and ``lo_`` and ``hi_`` per measure.
    A sketch has a bounded number of buckets, so each window here is small."""
    merged = sketch.groupBy(*keys, "m", "v").agg(F.sum("n").alias("n"))
    over = Window.partitionBy(*keys, "m")
    ranked = merged.select(
        *keys,
        "m",
        "v",
        F.sum("n").over(over.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(over).alias("all"),
    )
    at = F.col("v")
    quartiles = ranked.groupBy(*keys, "m").agg(
        F.max("all").alias("docs"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), at)).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), at)).alias("q3"),
    )
    aggregates = [F.max("docs").alias("docs")]
    for m, (_, _, least, below) in MEASURES.items():
        reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        own = F.col("m") == m
        aggregates.append(F.max(F.when(own, F.col("q3") + reach)).alias(f"hi_{m}"))
        if below:
            aggregates.append(F.max(F.when(own, F.col("q1") - reach)).alias(f"lo_{m}"))
    return quartiles.groupBy(*keys).agg(*aggregates)


def thresholds(sketch: DataFrame) -> DataFrame:
    """Fences per language and source, those of the language where the source has few documents."""
    own = fences(sketch, ["lang", "source"])
    pooled = fences(sketch, ["lang"])
    names = [c for c in pooled.columns if c not in ("lang", "docs")]
    pooled = pooled.select(F.col("lang").alias("__l"), *[F.col(c).alias(f"__{c}") for c in names])
    enough = F.col("docs") >= LEAST_GROUP
    return own.join(pooled, F.col("lang").eqNullSafe(F.col("__l"))).select(
        "lang", "source", *[F.when(enough, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in names]
    )


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          carry: list[str] | None = None) -> DataFrame:
    """``__row`` with the columns to carry (every column of ``df``; language and source must be
    among them), the base measures, and ``kept``.

    Rows are judged one by one: repeated rows get the same verdict, null and empty texts fail the
    base rules, null languages and sources are groups of their own.  Measured rows and thresholds
    are written to the shared folder, so texts are read once, and Spark sees the size of the
    thresholds before it chooses how to join them.  No text is shuffled unless the thresholds
    exceed its broadcast limit.
    """
    measured = stored(measure(df, text, carry), "measured")
    limits = stored(thresholds(stored(sketches(measured, lang, source), "sketch")), "thresholds")
    limits = limits.withColumnsRenamed({c: f"__{c}" for c in limits.columns})
    tests = []
    for m, (_, _, _, below) in MEASURES.items():
        tests.append(_scaled(m) <= F.col(f"__hi_{m}"))
        if below:
            tests.append(_scaled(m) >= F.col(f"__lo_{m}"))
    same = F.col(f"__row.`{lang}`").eqNullSafe(F.col("__lang")) & F.col(f"__row.`{source}`").eqNullSafe(F.col("__source"))
    inside = F.coalesce(reduce(Column.__and__, tests), F.lit(False))
    judged = measured.join(limits, same, "left")
    return judged.select("__row", *BASE, (~F.col("base_failed") & inside).alias("kept"))


def keep_good(df: DataFrame) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    return judge(df).where("kept").select("__row.*")
