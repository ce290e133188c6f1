"""Evaluation of verdicts: confusion, metrics, reports, attribution; data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_label(level: Column) -> Column:
    return F.when(level == "DANGEROUS", 2).when(level == "SUSPICIOUS", 1).otherwise(0)


def cube(df: DataFrame, *by: str) -> DataFrame:
    """by..., label, pred, n: the cells that every report below is a sum of. Reports take rows of messages or these cells."""
    return df.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))


def _cells(df: DataFrame) -> DataFrame:
    return df if "n" in df.columns else df.withColumn("n", F.lit(1))


def _many(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")


def confusion(df: DataFrame) -> DataFrame:
    return _cells(df).groupBy("label").pivot("pred", [0, 1, 2]).agg(F.sum("n")).na.fill(0).select("label", *[F.col(str(k)).alias(f"pred_{k}") for k in range(3)])


def three_levels(df: DataFrame, *by: str) -> DataFrame:
    y, p = F.col("label"), F.col("pred")
    rate = lambda a, b: F.try_divide(_many(a), _many(b))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return _cells(df).groupBy(*by).agg(
        total.alias("n"), F.try_divide(_many(y == p), total).alias("accuracy"), rate((y == 2) & (p == 2), y == 2).alias("recall_dangerous"), rate((y == 2) & (p > 0), y == 2).alias("caught"),
        _many((y == 2) & (p == 0)).alias("missed_as_safe"), rate((y == 0) & (p > 0), y == 0).alias("false_alarm"), _many((y == 0) & (p == 2)).alias("false_alarms_dangerous"),
    )


def binary(df: DataFrame, alarm: int = 1, *by: str) -> DataFrame:
    """Counts and rates of warnings of level `alarm` or more against any bad label; a rate is 0 where it is undefined."""
    bad, warned = F.col("label") > 0, F.col("pred") >= alarm
    c = _cells(df).groupBy(*by).agg(_many(bad & warned).alias("tp"), _many(~bad & warned).alias("fp"), _many(bad & ~warned).alias("fn"), _many(~bad & ~warned).alias("tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumn("precision", zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", zero(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("false_positive_rate", zero(F.col("fp"), F.col("fp") + F.col("tn")))


def by_class(df: DataFrame, *by: str) -> DataFrame:
    """precision, recall, f1 and support of each class."""
    each = _cells(df).withColumn("class", F.explode(F.lit([0, 1, 2])))
    y, p = F.col("label") == F.col("class"), F.col("pred") == F.col("class")
    c = each.groupBy(*by, "class").agg(_many(y & p).alias("hit"), _many(p).alias("said"), _many(y).alias("support"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select(*by, "class", zero(F.col("hit"), F.col("said")).alias("precision"), zero(F.col("hit"), F.col("support")).alias("recall"), zero(2.0 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


def sliced(df: DataFrame, by: str) -> DataFrame:
    """Accuracy by slice, and of all rows (null slice), in one rollup."""
    return _cells(df).rollup(by).agg(F.sum("n").cast("long").alias("n"), F.try_divide(_many(F.col("label") == F.col("pred")), F.sum("n")).alias("accuracy"))


def mean_p95_max(df: DataFrame, value: str) -> DataFrame:
    """p95 is the element with number int(0.95 n), from 1, of the sorted values; nulls don't count.

    A sketch whose ranks are off by a millionth of the rows at most bounds it from both sides; only distinct values between
    the bounds are sorted. Without values the result is a row of nulls.
    """
    v = F.col(value)
    whole = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    n = whole.first()["n"]
    if not n:
        return whole.select("mean", F.col("max").alias("p95"), "max")
    at = max(1, int(0.95 * n))
    low, high = df.agg(F.percentile_approx(v, [max(0.0, (at - 1) / n - 2e-6), min(1.0, at / n + 2e-6)], 1_000_000)).first()[0]
    below = df.agg(F.count_if(v < low)).first()[0]
    counts = df.where(v.between(low, high)).groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    run = counts.select("v", (F.sum("n").over(Window.orderBy("v")) + below).alias("upto"))
    return whole.crossJoin(F.broadcast(run.agg(F.min(F.when(F.col("upto") >= at, F.col("v"))).alias("p95")))).select("mean", "p95", "max")


def distribution(df: DataFrame, by: str) -> DataFrame:
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(by, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def quality(df: DataFrame, key: str, text: str, label: str, label_name: str | None = None, names: dict[int, str] | None = None, sizes: tuple[int, int] = (1, 1 << 62)) -> DataFrame:
    """One row of checks, of one scan: each row gives its id and its text as a value to be counted, and its faults with the first.

    names: what label_name must be for each label; sizes: how many rows there should be.
    """
    fault = lambda c: F.when(c, 1).otherwise(0).cast("long")
    known = F.col(label).isin(0, 1, 2)
    wrong = F.lit(False)
    if label_name:
        right = F.create_map(*[F.lit(x) for p in (names or {}).items() for x in p])[F.col(label)]
        wrong = known & ~F.coalesce(F.col(label_name) == right, F.lit(False))
    faults = {"no_id": F.col(key).isNull(), "blank": F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "bad_label": F.coalesce(~known, F.lit(True)), "wrong_name": F.coalesce(wrong, F.lit(False))}
    slim = df.select(F.col(key).cast("string").alias("id"), F.sha2(F.lower(F.col(text)), 256).alias("text"), *[fault(c).alias(f"_{k}") for k, c in faults.items()])
    first = F.struct(F.lit("id").alias("kind"), F.col("id").alias("value"), *[F.col(f"_{k}").alias(k) for k in faults])
    second = F.struct(F.lit("text").alias("kind"), F.col("text").alias("value"), *[F.lit(0).cast("long").alias(k) for k in faults])
    values = slim.select(F.explode(F.array(first, second)).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("m"), *[F.sum(f"x.{k}").alias(k) for k in faults])
    more = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("m") - 1)), F.lit(0))
    n = F.coalesce(F.sum(F.when(F.col("kind") == "id", F.col("m"))), F.lit(0))
    return values.agg(n.alias("n"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in faults], more("id").alias("repeated_id"), more("text").alias("repeated_text"), n.between(*sizes).alias("size_fits"))


def attribution(hits: DataFrame) -> DataFrame:
    """How often each rule fires on safe and on dangerous messages."""
    return hits.groupBy("rule_id").agg(F.count_if(F.col("label") == 0).alias("false_alarms"), F.count_if(F.col("label") == 2).alias("catches"), F.count("*").alias("n"))
