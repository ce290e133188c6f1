"""Messages judged by their distinct texts: the verdicts are those of the row-local pipeline, and copies don't reach the rules."""

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilspark.operators import linear_model, scoring
from vigilspark.plans import registry

SF = "/root/testdata/sf0.001"
COLUMNS = ["level", "score", "chosen", "explanation", "badge", "matched_rules"]


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """Events five times over in one file of one row group, ids shifted by a multiple of every period of the templates and slots, so that their texts repeat."""
    path = tmp_path_factory.mktemp("copied")
    duckdb.sql(f"COPY (SELECT e.* REPLACE (event_id + k * 68 * 840 * 4 AS event_id) FROM '{SF}/events.parquet' e, range(5) r(k)) TO '{path}/events.parquet' (FORMAT parquet, ROW_GROUP_SIZE 1000000)")
    return str(path)


@pytest.mark.parametrize("small", [50_000, 0])
def test_verdicts_are_those_of_rows(spark, small):
    """By broadcast and by hash with a common text; null, blank and too long texts have no verdict."""
    m = registry.msgs(spark, SF).select(F.col("msg_id").cast("long").alias("k"), "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \t"), (-4, "x" * 2001), *[(-k, "Chuyển gấp 500k nhé") for k in range(5, 105)], (-200, "chuyển gấp 500k nhé"), (-201, "olm.vn bit.ly")], "k long, text string")
    m = m.unionByName(odd)
    rows = lambda df: sorted(str(r) for r in df.select("k", "text", *COLUMNS).collect())
    assert rows(scoring.by_text(m, scoring.score, *COLUMNS, small=small)) == rows(scoring.score(m))


def test_no_rows(spark):
    none = spark.createDataFrame([(1, None)], "k long, text string")
    assert scoring.by_text(none, scoring.score, "level").count() == 0


@pytest.mark.parametrize("name", ["f_levels", "j7_report_by_source", "f17_f19_texts", "k6_k7_records", "g1_g5_advice", "f13_categories", "d1_d2_rule_hits", "d11_attribution", "f14_top_hits", "l2_stream_counts", "f7_f9_h5_ml_layer"])
def test_rules_see_each_text_once(spark, copied, monkeypatch, name):
    """Five copies of every message are no more work for the rules than one."""
    seen, scan = [], scoring.scan

    def counted(df, *rules):
        assert not df.isStreaming
        seen.append(df.count())
        return scan(df, *rules)

    class Enough(Exception):
        pass

    def once(df, *rules):
        counted(df, *rules)
        raise Enough

    monkeypatch.setattr(scoring, "scan", once)
    if name == "f7_f9_h5_ml_layer":
        monkeypatch.setattr(linear_model, "train", lambda df: None)
        monkeypatch.setattr(linear_model, "predict", lambda model, df: df.withColumn("ml", F.lit(None).cast("struct<safe: double, suspicious: double, dangerous: double>")))
    with pytest.raises(Exception):  # noqa: B017 - a stream wraps it
        registry.queries()[name](spark, copied).collect()
    m = registry.msgs(spark, copied)
    assert seen == [m.select("text").distinct().count()] and seen[0] * 5 <= m.count()


def test_one_row_group_is_many_tasks(spark, copied):
    """A file that is split by its bytes has its rows in one part where it has one row group; rows are dealt all the same."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        events = registry.table(spark, copied, "events")
        assert events.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in registry.spread(events).groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) * 4 <= sum(sizes)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_equal_texts_reach_the_model_once(spark, monkeypatch):
    """Texts are counted before they are folded, and folded texts that are equal are still one row of the fit."""
    df = spark.createDataFrame([(t, k) for t, k in (("Nạp thẻ gấp", 2), ("nap the gap", 2), ("nap the gap", 0), ("đi học", 0), (None, 1), ("đi học", None))], "text string, label int")
    ready, _, n, weight = linear_model.fit_rows(df)
    got = sorted((r["label"], r["weight"]) for r in ready.select("label", "weight").collect())
    assert n == 4 and weight == pytest.approx(1 + 1 + 1.6 * 2) and got == [(0.0, 1.0), (0.0, 1.0), (2.0, 3.2)]
