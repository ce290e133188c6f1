"""Deterministic splits and samples: every choice follows from a hash of the seed and a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position(seed: int, *keys: str) -> Column:
    """A number from 0 to 2**52 that looks random and is the same in any engine with MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def predefined(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.when(F.coalesce(F.col("split"), F.lit("")) == "test", "test").otherwise("train"))


def by_group(df: DataFrame, group: str, share: float, key: str | None = None, seed: int = 42) -> DataFrame:
    """The first share of the groups, by hash, is the test part. Rows without a group are a group of their own by `key`, or all one group without it."""
    own = F.col(group) if key is None else F.coalesce(F.col(group).cast("string"), F.col(key).cast("string"))
    df = df.withColumn("_g", own)
    groups = ranked(df.select("_g").distinct().withColumn("_one", F.lit(0)), "_one", "_g", seed)
    parts = groups.select(F.col("_g").alias("_h"), F.when(F.col("_rank") <= F.ceil(share * F.col("_all")), "test").otherwise("train").alias("part"))
    return df.join(parts, F.col("_g").eqNullSafe(F.col("_h"))).drop("_g", "_h")


def ranked(df: DataFrame, label: str, key: str, seed: int = 42, buckets: int = 256) -> DataFrame:
    """Adds _rank, from 1 by hash within the label, and _all, its rows. Ranks add up over buckets of the hash, so a label is no single task."""
    p = position(seed, key)
    df = df.withColumn("_p", p).withColumn("_b", F.floor(F.col("_p") / ((1 << 52) // buckets)).cast("int"))
    counts = df.groupBy(label, "_b").agg(F.count("*").alias("n"))
    w = Window.partitionBy(label)
    base = counts.select(label, "_b", F.coalesce(F.sum("n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(w).alias("all"))
    numbered = df.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_p", key))).join(base, [label, "_b"])
    return numbered.withColumn("_rank", F.col("base") + F.col("_r")).withColumn("_all", F.col("all")).drop("_p", "_b", "_r", "base", "all")


def stratified(df: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """Of each label the first share of rows by hash is the test part."""
    return ranked(df, label, key, seed).withColumn("part", F.when(F.col("_rank") <= F.round(share * F.col("_all")), "test").otherwise("train")).drop("_rank", "_all")


def capped(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(position(seed, key), key).limit(n)


def first(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
