import corpus_pipeline as cp
from vigilspark.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == cp.COLUMNS, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    assert not [r for r in docs.collect() if "token = \"" in r["text"] and "[SECRET]" not in r["text"]]
    pieces = cp.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]
