r"""Places of regular-expression matches, from built-in functions only.

Spark's functions give a regular expression's matches, but not their places. Splitting the text by the same expression
gives what lies between, so lengths add up to places. All lengths count code points. Patterns are written so that Java
neither recurses (possessive groups) nor rescans a run of characters from each of its places (a look-behind, or \G right
after a match).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPAN = "struct<start: bigint, end: bigint, match: string, before: string, after: string>"


MOST, LEAST = (lambda a, x: F.greatest(a, x)), (lambda a, x: F.least(a, x))


def running(values: Column, combine, zero: Column) -> Column:
    """Of an array of numbers, combine() over each place and all before it.

    A fold that gathers its results would copy them at each place. Folds of blocks, and of blocks of blocks, keep the work for a place to a few blocks.
    """
    fold = lambda a: F.aggregate(a, zero, combine)
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.shiftright(F.size(a) - 1, 6), F.lit(0))), lambda k: fold(F.slice(a, k * 64 + 1, F.lit(64))))

    def every(levels: Column) -> Column:
        v, one, two = levels["v"], levels["one"], levels["two"]

        def upto(_: Column, i: Column) -> Column:
            far, near = F.shiftright(i, 12), F.shiftright(i, 6)
            parts = F.array(fold(F.slice(two, F.lit(1), far)), fold(F.slice(one, far * 64 + 1, near - far * 64)), fold(F.slice(v, near * 64 + 1, i - near * 64 + 1)))
            return fold(parts)

        return F.transform(v, upto)

    levels = common.let(values, lambda v: common.let(blocks(v), lambda one: F.struct(v.alias("v"), one.alias("one"), blocks(one).alias("two"))))
    return common.let(levels, every)


def find(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]], near: int = 40) -> DataFrame:
    """For each name an array<SPAN> column of the matches, leftmost first and not overlapping, each with up to `near` characters on either side, but none of another match.

    patterns: name -> (regular expression, a cheap condition without which there is no match, or None).
    Each step is a projection of its own, so that no expression is evaluated twice.
    """
    t = F.col(text)
    none, never = F.array().cast("array<string>"), F.array().cast(f"array<{SPAN}>")
    df = df.select(
        "*",
        *[
            (F.regexp_extract_all(t, F.lit(p), F.lit(0)) if guard is None else F.when(guard, F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none)).alias(f"_m_{name}")
            for name, (p, guard) in patterns.items()
        ],
    )
    df = df.select("*", *[F.when(F.size(f"_m_{name}") > 0, F.split(t, p, -1)).alias(f"_g_{name}") for name, (p, _) in patterns.items()])
    for name in patterns:
        m, g = F.col(f"_m_{name}"), F.col(f"_g_{name}")

        def span(x: Column) -> Column:
            start = x["end"] - F.length(x["m"])
            return F.struct(start.alias("start"), x["end"].alias("end"), x["m"].alias("match"), F.right(x["gap"], F.lit(near)).alias("before"), F.left(x["next"], F.lit(near)).alias("after"))

        gaps = F.slice(g, F.lit(1), F.size(m))
        lengths = F.zip_with(m, gaps, lambda x, y: (F.length(x) + F.length(y)).cast("bigint"))
        ends = running(lengths, lambda a, x: a + x, F.lit(0).cast("bigint"))
        parts = F.arrays_zip(m.alias("m"), gaps.alias("gap"), F.slice(g, F.lit(2), F.size(m)).alias("next"), ends.alias("end"))
        df = df.withColumn(name, F.when(g.isNotNull(), F.transform(parts, span)).otherwise(never))
    return df.drop(*[f"_{a}_{name}" for name in patterns for a in "mg"])


def distinct(spans: Column) -> Column:
    """Sorted, without repeats."""
    return common.let(F.array_sort(spans), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))


def listing(spans: Column) -> Column:
    """kind:start:end of an array<struct<start, rank, kind, end, ...>>, by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """Spans as struct<start, rank, kind, end>, which sort by start and then rank."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))
