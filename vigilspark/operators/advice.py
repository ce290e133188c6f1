"""Advice for verdicts: content blocks, a stable quiz, steps, grading of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as cat


def blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, w, s, t, tip) for b, (w, s, t, tip) in cat.ADVICE.items()], "block string, warning string, steps array<string>, card_title string, card_tip string").coalesce(1)


def quizzes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, b, t, list(zip(ids, texts, strict=True)), ok, why) for q, b, t, ids, texts, ok, why in cat.QUIZZES], "quiz_id string, block string, question string, options array<struct<id: string, text: string>>, correct string, explanation string").coalesce(1)


def block_of(level: Column, category: Column) -> Column:
    return F.when((level != "SAFE") & (category == "SAFE"), "GENERIC_CAUTION").when(category.isin(list(cat.ADVICE)), category).otherwise("SAFE")


def quiz_number(seed: Column, n: Column) -> Column:
    """The first byte of SHA-256, modulo the number of quizzes."""
    return F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 2), 16, 10).cast("int") % n


def advise(verdicts: DataFrame, seed: Column) -> DataFrame:
    """verdicts (level, category) with advice; dims are constants of a few rows. Rows with an unknown level are marked, not dropped."""
    spark = verdicts.sparkSession
    known = F.col("level").isin("SAFE", "SUSPICIOUS", "DANGEROUS")
    own = quizzes(spark).groupBy("block").agg(F.array_sort(F.collect_list("quiz_id")).alias("quiz_ids"))
    df = verdicts.withColumn("block", block_of(F.col("level"), F.col("category"))).join(F.broadcast(blocks(spark)), "block", "left").join(F.broadcast(own), "block", "left")
    golden = F.transform(F.lit(cat.GOLDEN), lambda g, i: F.format_string("%d. %s", i + 1, g))
    return df.select(
        *[F.col(f"`{c}`") for c in verdicts.columns], "block", F.when(~known, "BAD_LEVEL").alias("error_code"),
        F.when(F.col("level") == "SUSPICIOUS", F.concat(F.lit("Not certain. "), F.col("warning"))).otherwise(F.col("warning")).alias("warning"),
        F.when(F.col("level") == "DANGEROUS", F.concat("steps", golden)).otherwise(F.col("steps")).alias("steps"), "card_title", "card_tip",
        F.element_at("quiz_ids", quiz_number(seed, F.size("quiz_ids")) + 1).alias("quiz_id"),
    )


def grade(answers: DataFrame) -> DataFrame:
    """answers (quiz_id, option_id) with is_correct, null and an error for unknown quizzes."""
    q = quizzes(answers.sparkSession).select("quiz_id", "correct")
    df = answers.join(F.broadcast(q), "quiz_id", "left")
    return df.withColumn("is_correct", F.upper(F.trim("option_id")) == F.col("correct")).withColumn("error_code", F.when(F.col("correct").isNull(), "UNKNOWN_QUIZ")).drop("correct")
