"""Best-fit packing of tokenized documents by exact-complement hashing.

Only lengths matter for the plan, and there are at most `width` of them, so the plan is made from the counts of each
length: the longest piece left opens a sequence, and single lengths, pairs and triples that fill its gap exactly are looked up among
the lengths still available; where none fills it, the best fit is taken, again and again. One step serves as many
sequences as the counts allow. Spark then gives every piece its place: pieces of a length are numbered through counts by
bucket, and a number falls into one range of the plan, which has a few rows for each length.

Null text: empty. Every document has one end token at least, so an empty one is a piece of length 1. Repeated rows are
packed each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bpe import codec

PIECES = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"


def cut(n: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of `width`, but for the first."""
    first = (n - 1) % width + 1
    return [(0, first), *((s, width) for s in range(first, n, width))]


def pieces(text: Column, path: str, width: int, end_id: int) -> Column:
    @F.pandas_udf(PIECES)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c, end = codec(path, trie=False), end_id.to_bytes(4, "little")
        for s in texts:
            out = []
            for ids in c.encode_each(s):
                ids += end
                out.append([{"piece": k, "start": a, "length": n, "ids_crc32": zlib.crc32(ids[4 * a : 4 * (a + n)])} for k, (a, n) in enumerate(cut(len(ids) // 4, width))])
            yield pd.Series(out, dtype=object)

    return run(common.whole(text))


def fill(gap: int, left: np.ndarray) -> list[int]:
    """One to three available lengths that fill the gap exactly, longest first; else the longest that fits; else none."""
    if gap <= 0:
        return []
    have = left[: gap + 1] > 0
    if have[gap]:
        return [gap]
    size = np.arange(gap + 1)
    pair = have & have[::-1] & (2 * size >= gap)
    if gap % 2 == 0:
        pair[gap // 2] &= left[gap // 2] > 1
    if pair.any():
        b = int(np.flatnonzero(pair)[-1])
        return [b, gap - b]
    for a in np.flatnonzero(have)[::-1]:
        rest = gap - int(a)
        if 3 * a < gap or rest <= 0:
            continue
        two = have[: rest + 1] & have[rest::-1]
        for b in np.flatnonzero(two & (np.arange(rest + 1) <= a) & (2 * np.arange(rest + 1) >= rest))[::-1]:
            out = [int(a), int(b), rest - int(b)]
            if all(left[x] >= n for x, n in Counter(out).items()):
                return out
    fits = np.flatnonzero(have)
    return [int(fits[-1])] if len(fits) else []


def plan(counts: dict[int, int], width: int) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, number of such sequences). At most a few patterns for each length, however many pieces."""
    left, out = np.zeros(width + 1, dtype=np.int64), []
    for n, c in counts.items():
        left[n] = c
    while (have := np.flatnonzero(left)).size:
        own = [int(have[-1])]
        left[own[0]] -= 1
        while more := fill(width - sum(own), left):
            for n in more:
                left[n] -= 1
            own += more
        need = Counter(own)
        again = 1 + min(int(left[n]) // c for n, c in need.items())
        for n, c in need.items():
            left[n] -= (again - 1) * c
        out.append((own, again))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, last number, first sequence, offset): numbers of pieces of a length, from 0, in the order of the plan."""
    used, out, sequence = Counter(), [], 0
    for own, times in patterns:
        offset = 0
        for n in own:
            out.append((n, used[n], used[n] + times - 1, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return out


def numbered(rows: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """`number`, from 0, of each row within `key`. A key's rows are counted by bucket, so that a frequent key is no single task; only the counts meet."""
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order))
    return rows.withColumn("inside", inside).join(base, [key, "bucket"]).withColumn("number", F.col("base") + F.col("inside") - 1).drop("bucket", "base", "inside")


def pack(docs: DataFrame, path: str, width: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    common.ship(spark)
    cuts = docs.select("doc_id", F.explode(pieces(F.col("text"), path, width, end_id)).alias("p")).select("doc_id", "p.*")
    cuts = common.materialize(cuts)
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `width` rows
    table = slots(plan(counts, width))
    if not table:
        return cuts.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    ranges = spark.createDataFrame(table, "length long, first long, last long, sequence long, offset long").coalesce(1)
    buckets = 8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = numbered(cuts, "length", ["doc_id", "piece"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    placed = rows.join(F.broadcast(ranges), "length").where(F.col("number").between(F.col("first"), F.col("last")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), "offset")
