"""Text features: terms of a text, TF-IDF, weights of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize


def word_terms(text: Column) -> Column:
    """Words of two characters or more, and pairs of neighbours."""
    w = F.regexp_extract_all(text, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = tx.let(w, lambda a: F.when(F.size(a) > 1, F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.concat_ws(" ", F.get(a, i - 1), F.get(a, i)))).otherwise(F.array().cast("array<string>")))
    return F.concat(w, pairs)


def char_terms(text: Column, low: int = 3, high: int = 5) -> Column:
    """Letter runs inside words, with a space on either side; a word shorter than a length gives itself once and no longer runs."""

    def cut(padded: Column, n: int):
        return lambda i: F.substring(padded, i, F.lit(n))  # a second parameter would be the index

    def word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        runs = []
        for n in range(low, high + 1):
            some = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), cut(padded, n))
            whole = F.array(padded) if n == low else F.array().cast("array<string>")
            runs.append(F.when(F.length(padded) > n, some).when(F.length(padded) == n, F.array(padded)).otherwise(whole))
        return F.concat(*runs)

    return F.flatten(F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), word))


def tfidf(df: DataFrame, key: str, terms: Column, min_df: int = 1) -> DataFrame:
    """key, term, tf, df, weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of length 1 for each key. Counts are written once; document frequencies and lengths come from them."""
    tf = materialize(df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")))
    n = df.count()
    dfs = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    raw = tf.join(dfs, "term").withColumn("raw", (1 + F.log(F.col("tf"))) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    raw = materialize(raw)
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", "tf", "df", (F.col("raw") / F.col("norm")).alias("weight"))


def class_weights(df: DataFrame, label: str, boost: dict[int, float] | None = None) -> DataFrame:
    """label, n, weight: rows / (classes * rows of the class), with a factor for some classes."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    factor = F.lit(1.0)
    for k, v in (boost or {2: 1.3}).items():
        factor = F.when(F.col(label) == k, v).otherwise(factor)
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("kinds") * F.col("n")) * factor).alias("weight"))
