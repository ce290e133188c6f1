"""Scoring of a message stream, and windowed counts with late rows dropped beyond the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import links as lk
from ..operators import scoring
from ..sources import io


def read(spark: SparkSession, path: str, schema, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def score(messages: DataFrame) -> DataFrame:
    """The same columns as in batch: the pipeline has no state."""
    return scoring.score(messages).select("msg_id", "ts", "channel", "level", "score", F.col("chosen").alias("category"), "summary")


def score_by_text(messages: DataFrame, path: str, state: str) -> StreamingQuery:
    """The same, written to path, once over all that is there: equal texts of a micro-batch are judged once. A batch that is run again after a failure overwrites its own folder."""

    def judge(batch: DataFrame, number: int) -> None:
        df = scoring.by_text(batch.select("msg_id", "ts", "channel", "text"), scoring.score, "level", "score", "chosen", "summary")
        df.select("msg_id", "ts", "channel", "level", "score", F.col("chosen").alias("category"), "summary").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return messages.writeStream.foreachBatch(judge).option("checkpointLocation", state).trigger(availableNow=True).start()


def counts(scored: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return scored.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "channel", "level").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "channel", "level", "n")


def mark_blocked(links: DataFrame, blocklist: str, path: str, state: str) -> StreamingQuery:
    """Write links (host) with `blocked` to path, once over all that is there. The list (domain) in the folder `blocklist` is read for each micro-batch, so a new one takes effect with the next.

    A batch that is run again after a failure overwrites its own folder.
    """

    def mark(batch: DataFrame, number: int) -> None:
        found = lk.mark_blocked(batch, batch.sparkSession.read.parquet(blocklist))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return links.writeStream.foreachBatch(mark).option("checkpointLocation", state).trigger(availableNow=True).start()


def score_batches(messages: DataFrame, blocklist: str, rules: str, path: str, state: str) -> StreamingQuery:
    """Score messages with the blocklist (domain) and the knowledge (tables of dims()) that the folders `blocklist` and `rules` hold when a micro-batch begins, once over all that is there.

    Each list has a folder for each of its versions, named so that the newest sorts last; the versions are written beside each verdict. Messages that can't be judged go to
    `bad` beside `good`. A batch that is run again after a failure overwrites its own folders.
    """

    def newest(spark: SparkSession, folder: str) -> str:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return sorted(x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))[-1]

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        of_list, of_rules = newest(spark, blocklist), newest(spark, rules)
        known = io.knowledge({k: spark.read.parquet(f"{rules}/{of_rules}/{k}") for k in ("rules", "rule_patterns", "combos", "suppressions")})
        good, bad, _ = scoring.quarantine(batch)
        blocked = spark.read.parquet(f"{blocklist}/{of_list}")
        verdicts = scoring.by_text(good.select("msg_id", "ts", "channel", "text"), lambda t: scoring.score(t, blocked=blocked, knowledge=known), "level", "score", "chosen", "matched_rules")
        chosen = verdicts.select("msg_id", "ts", "channel", "level", "score", F.col("chosen").alias("category"), "matched_rules", F.lit(of_list).alias("blocklist"), F.lit(of_rules).alias("rules"))
        chosen.write.mode("overwrite").parquet(f"{path}/good/batch={number}")
        bad.select("msg_id", "ts", "channel", "error_code").write.mode("overwrite").parquet(f"{path}/bad/batch={number}")

    return messages.writeStream.foreachBatch(judge).option("checkpointLocation", state).trigger(availableNow=True).start()
