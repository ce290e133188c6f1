"""Document fingerprints by Order MinHash.

Every k characters of a text, numbered by occurrence (the same characters again are another item), are hashed by
`sketches` functions. For each function the `tuple_size` items of least hash are selected, put in the order of the text and
hashed together. The share of equal sketches estimates a likeness that falls with the edit distance, as order counts.
Texts shorter than k have themselves as their one item; an empty text has a fingerprint of its own.

Neighbours by ascending doc_id: rows are dealt to buckets by ranges of the id (bounds by quantiles, as many as configured
partitions), sorted there, and read one after the other; the first rows of each bucket also go to the one before,
and those of the first bucket to the last, so texts are shuffled once and no task sees more than its range.

Null texts count as empty, null ids come first, equal ids are ordered by text; repeated rows are each other's
neighbours. An empty table gives no rows; the only row of a table is its own neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, TUPLE, SKETCHES, SEED = 6, 2, 48, 20240607
BLOCK = 8192


def constants(sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a mask for each hash function."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, sketches, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, sketches, dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def items(text: str, k: int = K) -> np.ndarray:
    """A 64-bit hash for each k characters in the order of the text, with the number of their occurrence."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = max(1, len(c) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(c))):
        h = (h ^ c[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = mix(h + np.uint64(len(c) < k))
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(n, dtype=bool)
    new[1:] = s[1:] != s[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    times = np.empty(n, dtype=np.uint64)
    times[order] = (np.arange(n) - start).astype(np.uint64)
    return mix(h ^ (times * np.uint64(0xD6E8FEB86659FD93)))


def sketch(text: str, factors: np.ndarray, masks: np.ndarray, k: int = K, size: int = TUPLE) -> np.ndarray:
    """One 32-bit value for each hash function. Items are read in blocks, so memory doesn't grow with the text."""
    h = items(text, k)
    low, m = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), len(factors)
    high = (h >> np.uint64(32)).astype(np.uint32)
    best = np.full((m, size), np.iinfo(np.uint64).max, dtype=np.uint64)  # (hash, place) pairs, least first
    rows = np.arange(m)
    for a in range(0, len(low), BLOCK):
        x = (low[None, a : a + BLOCK] ^ masks[:, None]) * factors[:, None]
        for _ in range(min(size, x.shape[1])):
            at = x.argmin(axis=1)
            value = (x[rows, at].astype(np.uint64) << np.uint64(32)) | (at + a).astype(np.uint64)
            better = value < best[:, -1]
            best[better, -1] = value[better]
            best.sort(axis=1)
            x[rows, at] = np.iinfo(np.uint32).max
    places = np.sort((best & np.uint64(0xFFFFFFFF)).astype(np.int64), axis=1)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(size):
        p = places[:, j]
        there = p < len(low)
        value = np.where(there, (low[np.minimum(p, len(low) - 1)].astype(np.uint64) << np.uint64(32)) | high[np.minimum(p, len(low) - 1)], np.uint64(0))
        out = mix((out * np.uint64(31)) ^ value)
    return (out & np.uint64(0xFFFFFFFF)).astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, bucket, ahead: rows by ranges of the id; `ahead` marks the copies of a bucket's first rows in the bucket before."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole(F.col("text")).alias("text"))
    bounds = sorted(set(df.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.2 / buckets)))
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        df = Bucketizer(splits=splits, inputCol="_key", outputCol="_b").transform(df.withColumn("_key", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308))))
        df = df.withColumn("bucket", F.col("_b").cast("int")).drop("_key", "_b")
    else:
        df = df.withColumn("bucket", F.lit(0))
    # the first id of each bucket: as many rows as buckets; null ids are before all others
    first = sorted((r["bucket"], r["id"] if not r["none"] else None) for r in df.groupBy("bucket").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("none")).collect())
    if not first:
        return df.withColumn("ahead", F.lit(0))
    ids = {b: i for b, i in first}
    order = [b for b, _ in first]
    back = {b: order[k - 1] for k, b in enumerate(order)}  # the first bucket's go to the last
    n = order[-1] + 1
    first_id = F.element_at(F.lit([ids.get(b) if ids.get(b) is not None else -(1 << 62) for b in range(n)]).cast("array<bigint>"), F.col("bucket") + 1)
    to = F.element_at(F.lit([back.get(b, -1) for b in range(n)]), F.col("bucket") + 1)
    is_first = F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))) == first_id
    both = F.when(is_first, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead")), F.struct(to.alias("bucket"), F.lit(1).alias("ahead")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead"))))
    return df.select("doc_id", "text", F.explode(both).alias("x")).select("doc_id", "text", "x.bucket", "x.ahead")


def report(docs: DataFrame, k: int = K, size: int = TUPLE, sketches: int = SKETCHES) -> DataFrame:
    spark = docs.sparkSession
    common.ship(spark)
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt(docs, 8 * partitions).repartition(partitions, "bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, masks = constants(sketches)
        finger = lambda t: sketch(t, factors, masks, k, size)
        held = None  # the row before: bucket, id, text, fingerprint
        for batch in batches:
            out = []
            for doc_id, text, bucket, ahead in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "bucket", "ahead")), strict=True):
                if ahead and (held is None or held[0] != bucket):
                    continue  # only the first of the rows ahead is a neighbour
                own = held[3] if held is not None and held[2] == text else finger(text)
                if held is not None and held[0] == bucket:
                    other = edited(held[2], text)
                    changed = own if other == text else held[3] if other == held[2] else finger(other)
                    hexed = held[3].tobytes().hex()
                    out.append((held[1], len(held[2]), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), hexed, changed.tobytes().hex(), likeness(held[3], changed), likeness(held[3], own)))
                held = None if ahead else (bucket, doc_id, text, own)
            yield pa.RecordBatch.from_pydict({f.name: [r[n] for r in out] for n, f in enumerate(SCHEMA)}, schema=SCHEMA)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
