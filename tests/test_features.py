import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vigilspark.operators import features, linear_model


def chars(text):
    out = []
    for w in text.split():
        w = f" {w} "
        for n in (3, 4, 5):
            out += [w[i : i + n] for i in range(len(w) - n + 1)] or [w]
            if len(w) <= n:
                break
    return out


def pairs(text):
    w = [x for x in text.split() if len(x) > 1]
    return [*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))]


TEXTS = ["win cash now now now", "call me later", "win a prize now", "see you later", "cash prize call now", "later maybe", "later maybe", ""]
LABELS = (2, 0, 2, 0, 1, 0, 0, 0)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, t, LABELS[k], "x") for k, t in enumerate(TEXTS)], "k int, text string, label int, _key string")


@pytest.fixture(scope="module")
def fitted(spark, rows):
    ready, terms, n, weight = linear_model.fit_rows(rows)
    return ready, terms, n, linear_model.classifier(weight).fit(ready)


def weights(text, terms, block):
    """Weights of one block by hand: index -> weight."""
    make, least = {"word": (pairs, 1), "char": (chars, 2)}[block]
    df = Counter(t for x in TEXTS for t in set(make(x)))
    names = {t for t, n in df.items() if n >= least}
    assert {t for b, t in terms if b == block} == names
    raw = {terms[block, t]: (1 + math.log(n)) * (math.log((1 + len(TEXTS)) / (1 + df[t])) + 1) for t, n in Counter(make(text)).items() if t in names}
    norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
    return {k: v / norm for k, v in raw.items()}


def test_vectors_have_both_blocks_with_their_weights(fitted):
    ready, terms, n, _ = fitted
    index = {(r["block"], r["term"]): r["idx"] for r in terms.collect()}
    assert sorted(index.values()) == list(range(len(index))) and n == len(TEXTS)
    got = sorted(tuple(round(x, 9) for x in r["v"]) for r in ready.select(vector_to_array("features").alias("v")).collect())
    want = set()
    for text in TEXTS:
        v = weights(text, index, "word") | weights(text, index, "char")
        want.add(tuple(round(v.get(k, 0.0), 9) for k in range(len(index))))
    assert got == sorted(want)
    assert sorted(r["weight"] for r in ready.where("label = 0").collect()) == [1.0, 1.0, 1.0, 2.0]  # equal texts are one row


@pytest.mark.parametrize("small", [10**6, 0])
def test_table_scores_are_the_models(spark, rows, fitted, small, monkeypatch):
    ready, terms, n, model = fitted
    tables = linear_model.as_tables(model, terms, n, spark)
    by_vector = {tuple(round(x, 9) for x in r["v"]): r["probability"] for r in model.transform(ready).select(vector_to_array("features").alias("v"), vector_to_array("probability").alias("probability")).collect()}
    index = {(r["block"], r["term"]): r["idx"] for r in terms.collect()}
    monkeypatch.setattr(linear_model, "COMMON", 3)
    out = {r["k"]: r for r in linear_model.predict(tables, rows, small=small).collect()}
    assert len(out) == len(TEXTS) and out[0]["_key"] != ""
    for k, text in enumerate(TEXTS):
        v = weights(text, index, "word") | weights(text, index, "char")
        p = by_vector[tuple(round(v.get(i, 0.0), 9) for i in range(len(index)))]
        assert list(out[k]["ml"]) == pytest.approx(list(p), abs=1e-6)
        assert out[k]["ml_class"] == max(range(3), key=lambda c: p[c])


def test_save_load_export(spark, rows, tmp_path):
    model = linear_model.train(rows)
    model.save(f"{tmp_path}/model")
    again = linear_model.load(spark, f"{tmp_path}/model")
    one = {r["k"]: list(r["ml"]) for r in linear_model.predict(model, rows).collect()}
    assert all(list(r["ml"]) == pytest.approx(one[r["k"]], abs=1e-12) for r in linear_model.predict(again, rows).collect())
    assert linear_model.load(spark, f"{tmp_path}/nothing") is None
    parts = linear_model.export(again)
    for short, exact, name in ((parts["terms"], again.terms, "idf"), (parts["intercepts"], again.intercepts, "intercept")):
        a, b = (sorted(r[name] for r in df.select(name).collect()) for df in (short, exact))
        assert a == pytest.approx(b, rel=5e-6) and all(x == 0 or float(f"{x:.6g}") == pytest.approx(x, rel=1e-12) for x in a)
    assert parts["weights"].count() == 3 * again.terms.count()


def test_null_text_has_no_score_and_unknown_words_have_the_intercepts(spark, rows):
    model = linear_model.train(rows)
    got = {r["k"]: r for r in linear_model.predict(model, spark.createDataFrame([(1, None), (2, "zzzz qqqq"), (3, "zzzz qqqq")], "k int, text string")).collect()}
    start = [r["intercept"] for r in model.intercepts.orderBy("class").collect()]
    e = [math.exp(x - max(start)) for x in start]
    assert got[1]["ml"] is None and got[1]["ml_class"] is None
    assert list(got[2]["ml"]) == list(got[3]["ml"]) == pytest.approx([x / sum(e) for x in e])


def test_cross_fitting_never_sees_the_group(spark):
    """A word that only one group has gives no score of its own to that group: its rows are judged by intercepts and shared terms."""
    texts = [(k, f"own{k % 6} common" if k % 2 else f"own{k % 6} other", k % 3, f"g{k % 6}") for k in range(48)]
    df = spark.createDataFrame(texts, "k int, text string, label int, g string")
    out = linear_model.cross_fitted(df, F.pmod(F.xxhash64("g"), 3), 3)
    assert out.columns == ["k", "text", "label", "g", "ml", "ml_class"] and out.count() == 48
    folds = {r["g"]: r["f"] for r in df.select("g", F.pmod(F.xxhash64("g"), 3).alias("f")).distinct().collect()}
    by_group = {r["g"]: list(r["ml"]) for r in out.collect()}
    for g, f in folds.items():
        others = df.where(F.pmod(F.xxhash64("g"), 3) != f)
        want = linear_model.predict(linear_model.train(others), df.where(F.col("g") == g)).first()["ml"]
        assert by_group[g] == pytest.approx(list(want), abs=1e-9)


def test_log_odds_by_hand(spark, rows):
    model = linear_model.log_odds(rows)
    got = {r["term"]: (r["df"], r["idf"], r["coefficients"]) for r in model.terms.where("block = 'word'").collect()}
    n = len(TEXTS)
    assert got["now"][0] == 3 and got["now"][1] == pytest.approx(math.log((1 + n) / 4) + 1)
    assert got["now"][2] == pytest.approx([math.log(1 / 6), math.log(2 / 6), math.log(3 / 6)])
    assert [r["intercept"] for r in model.intercepts.orderBy("class").collect()] == pytest.approx([math.log((1 + c) / (3 + n)) for c in (5, 1, 2)])


def test_counted(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],)], "t array<string>")
    assert [[tuple(x) for x in r[0]] for r in df.select(linear_model.counted(F.col("t"))).collect()] == [[("a", 1), ("b", 3), ("c", 1)], []]


def test_word_and_char_terms(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for text, r in zip(TEXTS, df.select(features.word_terms(F.col("t")).alias("w"), features.char_terms(F.col("t")).alias("c")).collect(), strict=True):
        assert sorted(r["w"]) == sorted(pairs(text)) and sorted(r["c"]) == sorted(chars(text))
