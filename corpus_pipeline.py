"""The corpus pipeline: toxicity, language, near duplicates, secrets, packing. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import jaccard_join, language, packing, secrets, toxicity
from vigilspark.llm.common import materialize, read
from vigilspark.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3  # documents with this score or more go


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It is fitted on labelled rows of this stage's input; texts are not shuffled."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("tox.score") < TOXIC).select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language."""
    return language.accepted(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id. Documents without an id stay.

    Of repeated rows (equal id and text) one stays. Rows of one id with unlike texts are no copies of each other: all
    texts of an id stay when one of them stands for its group.
    """
    docs = docs.select(*COLUMNS)
    found = jaccard_join.join(docs, size=5, percent=80).where(F.col("doc_id").isNotNull())
    ids = materialize(found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("n")).where(~F.col("first") | (F.col("n") > 1)))
    kept = docs.join(ids.where(~F.col("first")).select("doc_id"), "doc_id", "left_anti")
    repeated = ids.where("first").select("doc_id")
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets and access keys in their texts are replaced by a mark, and n_chars follows."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL can't express the classifiers, the similarity join or the tokenizer; tests check only columns, falling row counts and marks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
