"""A user's model as a third layer: batches of texts in, probabilities of the three levels out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def score(df: DataFrame, load: Callable, text: str = "text", name: str = "outer", batch: int = 256) -> DataFrame:
    """df with struct<safe, suspicious, dangerous>; null texts get null and never reach the model.

    load() is called once in each Python worker and gives a function from an array of texts to an array of three probabilities for each, so weights are read where they are used.
    """
    df = df.drop(name)
    model = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch)
    p = F.col("_p")
    scored = df.where(F.col(text).isNotNull()).withColumn("_p", model(F.col(text)))
    layer = "struct<safe: double, suspicious: double, dangerous: double>"
    scored = scored.withColumn(name, F.struct(p[0].alias("safe"), p[1].alias("suspicious"), p[2].alias("dangerous"))).drop("_p")
    return scored.unionByName(df.where(F.col(text).isNull()).withColumn(name, F.lit(None).cast(layer)))
