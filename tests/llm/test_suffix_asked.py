import zlib
from pathlib import Path
from urllib.parse import urlparse

from vigilspark.llm import suffix_model

plain = suffix_model.common.materialize
TAUGHT = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2]


def size(rows):
    return sum(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray))


def test_a_frequent_run_moves_once_for_each_chunk(spark):
    """What moves for a run doesn't grow with its uses in a chunk."""
    docs = spark.createDataFrame([(k, "again " * 2000) for k in TAUGHT[:20]], "doc_id long, text string").selectExpr("doc_id", "text", "false held_out").coalesce(1)
    assert 0 < size(suffix_model.packed(suffix_model.chunks(docs), 2, 1, True, 0, 1).collect()) < 2000


def test_longer_runs_are_asked_for_only_if_shorter_ones_are_listed(spark, monkeypatch):
    """Of 300 runs of three tokens three can be listed; all tables but the result are deleted, and that is whole."""
    rows = [(k, " ".join([*(f"w{k}x{i}" for i in range(140)), "a b c d"])) for k in TAUGHT[:2]] + [(1000, None)]
    asked, tables = [], []

    def materialize(df):
        tables.append(plain(df))
        if "gaps" in df.columns:
            asked.extend(len(suffix_model.loose(r["gaps"], "u8")) for r in tables[-1].where("level = 3").collect())
        return tables[-1]

    monkeypatch.setattr(suffix_model.common, "materialize", materialize)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = suffix_model.report(docs).collect()
    assert sum(asked) == 3 and len(out) == 3
    left = {Path(urlparse(f).path).parent.name for t in tables for f in t.inputFiles() if Path(urlparse(f).path).exists()}
    assert len(left) <= suffix_model.TREE_TURNS


def test_gaps_and_squeezed_values_come_back():
    np = suffix_model.np
    for x in (np.zeros(0, np.uint64), np.array([0, 5, 2**64 - 1, 3], np.uint64), np.arange(9, dtype=np.uint64) << np.uint64(60)):
        assert (np.cumsum(suffix_model.loose(suffix_model.squeezed(suffix_model.gaps(x)), np.uint64)) == x).all()
