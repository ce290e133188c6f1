"""Each stage of the pipeline on small tables: nulls, empty tables, repeated rows, ties, extra columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alba", "breno", "cirru", "dala", "eno", "fala", "gru", "hila", "ivo", "jamo", "kelu", "lomi"]


def prose(rnd, n=30):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(3)
    labels = [(k, 1, int(k % 5 == 0)) for k in range(200)]
    docs = [(k, prose(rnd) + (" vile nasty vile" if k % 5 == 0 else ""), "aa", "s1", 0) for k in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_empty_table_and_extra_columns(spark, folder, name):
    stage = dict(cp.STAGES)[name]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("x") for c in ("found", "tox", "component_id", "_row", "score", "base", "host", "lang_found")})
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0
    if name != "packing":
        assert stage(spark, docs, folder).columns == cp.COLUMNS == empty.columns


def test_toxic_documents_go_and_clean_ones_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.createDataFrame([(None, None, None, None, None), (900, "", "aa", "s1", 0)], SCHEMA))
    left = [r["doc_id"] for r in cp.drop_toxic(spark, docs, folder).collect()]
    assert sorted(x for x in left if x is not None) == [k for k in range(200) if k % 5] + [900] and left.count(None) == 1


def test_near_duplicates_of_repeated_ids(spark, folder):
    rnd = random.Random(5)
    a, b, c = (prose(rnd, 60) for _ in range(3))
    rows = [(1, a), (2, a + " extra"), (3, b), (3, b), (4, c), (4, prose(rnd, 50)), (None, a), (None, None), (7, None), (8, ""), (9, "")]
    docs = spark.createDataFrame([(k, t, "aa", "s", 0) for k, t in rows], SCHEMA)
    left = sorted(((r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(spark, docs, folder).collect()), key=str)
    assert left == sorted([(1, a), (3, b), rows[4], rows[5], (None, a), (None, None), (7, None), (8, ""), (9, "")], key=str)


def test_pieces_of_odd_rows(spark, folder):
    rows = [(1, None), (1, None), (None, "a b"), (2, "word " * 3000)]
    out = cp.pack(spark, spark.createDataFrame([(k, t, "aa", "s", 0) for k, t in rows], SCHEMA), folder).collect()
    assert len(out) == 3 + len([r for r in out if r["doc_id"] == 2]) and sum(r["length"] for r in out if r["doc_id"] == 2) >= 3000
