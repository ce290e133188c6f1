import math

import numpy as np
import pytest

from vigilspark.llm import language


def test_small_hosts_keep_their_prior_in_a_large_table(spark):
    model = language.Model(["aa", "bb"], {}, {})
    small = [("tiny.example.org", "xx", "bb")] * 30
    seen = spark.createDataFrame(small + [("h0.example.com", "xx", "aa")], "_host string, _said string, _text string").unionByName(
        spark.range(400_000).selectExpr("concat('h', id % 7, '.example.com') _host", "'xx' _said", "'aa' _text")
    )
    p = language.priors(seen, model)
    got = {r["_host"]: r["_prior"] for r in p.hosts.collect()}
    top = np.array([400_002, 31]) / (400_031 + 2)
    up = (np.array([0, 30]) + 20 * top) / 50
    assert got["tiny.example.org"] == pytest.approx(np.log((np.array([0, 30]) + 20 * up) / 50).tolist())
    row = spark.createDataFrame([(k, [0.0, -1.0, -50.0], None, None, h) for k, h in enumerate(["tiny.example.org", "h1.example.com"])], "k int, _ll array<double>, _text string, _said string, _host string")
    assert {r["k"]: r["lang_found"] for r in language.fuse(row, model, p).collect()} == {0: "bb", 1: "aa"} and math.isfinite(p.agree)


def test_declared_language_far_into_a_text(spark):
    texts = ["<!-- " + "licence " * 400 + '--> <HTML class=x lang="de">', '<html lang=fr>', "no markup", None]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["declared"] for r in language.from_documents(docs).collect()} == {0: "de", 1: "fr", 2: None, 3: None}


def test_every_language_is_fitted_however_rare(spark):
    common = spark.range(60 * 40).selectExpr("id doc_id", "concat('l', lpad(id % 60, 2, '0')) lang", "concat(repeat(concat(char(97 + id % 26), char(97 + id % 60 div 26)), 3), ' ', id) text")
    rare = spark.createDataFrame([(9000 + k, "zz", "żółw żaba źdźbło") for k in range(3)], "doc_id long, lang string, text string")
    model = language.fit(common.unionByName(rare), sample=20)
    assert len(model.names) == 61 and "zz" in model.names
    at = model.names.index("zz")
    assert model.word("żółw")[:-1].argmax() == at and model.grams["żół"][at] == pytest.approx(math.log(3.5 / 33))  # 3 rows of 3 were used


def test_whole_subtags(spark):
    tags = [("fil", "fil"), ("fil-PH", "fil"), ("pt-BR", "pt"), ("PT_br", "pt"), ("de", "de"), ("", None), (None, None), ("x-klingon", None), ("verylongtag", None), (" zh-Hant", "zh")]
    df = spark.createDataFrame([(t,) for t, _ in tags], "t string")
    assert [r[0] for r in df.select(language.primary(df.t)).collect()] == [w for _, w in tags]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(['<html lang="fil">', "<html lang='pt-BR'>", "<html lang=abcdefghijk>", "<HTML LANG=DE>"])], "doc_id long, text string, source string")
    seen = language.from_documents(docs)
    assert {r["doc_id"]: r["p"] for r in seen.select("doc_id", language.primary(seen.declared).alias("p")).collect()} == {0: "fil", 1: "pt", 2: None, 3: "de"}


def test_hosts_of_addresses(spark):
    urls = [("https://u:p@c.ex/x", "c.ex"), ("HTTP://B.Example:80/fi/x", "b.example"), ("http://a.b?x@y", "a.b"), ("a.b/c", ""), (None, ""), ("ftp://h.ex#f", "h.ex")]
    df = spark.createDataFrame([(u,) for u, _ in urls], "u string")
    assert [r[0] for r in df.select(language.host_of(df.u)).collect()] == [w for _, w in urls]
    pages = spark.createDataFrame([(1, "HTTP://U@B.Example/fi/x", "<p>x</p>"), (2, "http://c.ex/pt-BR/", None), (3, "http://c.ex/news/", "<html lang=fil-PH>"), (3, "http://c.ex/news/", "<html lang=fil-PH>")], "page_id long, url string, html string")
    rows = language.from_pages(pages)
    got = [tuple(r) for r in rows.select("page_id", "host", language.primary(rows.declared)).collect()]
    assert sorted(got) == [(1, "b.example", "fi"), (2, "c.ex", "pt"), (3, "c.ex", "fil"), (3, "c.ex", "fil")]


def test_posterior_by_hand_and_by_either_join(spark, monkeypatch):
    """Likelihoods, the hosts' smoothed priors and the declared language, multiplied; ties go to the first language."""
    model = language.Model(["aa", "bb"], {}, {})
    rows = [(k, [-(k % 3) * 1.0, -(k % 4) * 1.0, -9.0] if k % 7 else None, ("aa", "bb", None)[k % 3] if k % 7 else None, ("aa", "bb", "fil", None)[k % 4], ("x.one", "y.one", "z.two", "")[k % 4]) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, _ll array<double>, _text string, _said string, _host string")
    p = language.priors(df, model)
    known = [(r[2], r[4]) for r in rows]
    same, said = sum(r[2] is not None and r[3] == r[2] for r in rows), sum(r[3] in ("aa", "bb") and r[2] is not None for r in rows)
    agree = (same + 1) / (said + 2)
    top = [(sum(t == a for t, _ in known) + 1) / (sum(t is not None for t, _ in known) + 2) for a in ("aa", "bb")]
    smooth = lambda counts, up: [(c + 20 * u) / (sum(counts) + 20) for c, u in zip(counts, up, strict=True)]
    want = {}
    for k, ll, _, tag, host in rows:
        if ll is None:
            want[k] = ("und", 0.0)
            continue
        end = host.rsplit(".", 1)[-1]
        up = smooth([sum(t == a for t, h in known if h.rsplit(".", 1)[-1] == end) for a in ("aa", "bb")], top)
        prior = smooth([sum(t == a for t, h in known if h == host) for a in ("aa", "bb")], up)
        parts = [ll[n] + math.log(prior[n]) + ((math.log(agree) if tag == a else math.log((1 - agree) + 1e-6)) if tag in ("aa", "bb") else 0) for n, a in enumerate(("aa", "bb"))] + [ll[2] + math.log(0.01)]
        best = max(range(3), key=lambda n: parts[n])
        want[k] = (("aa", "bb", "und")[best], 1 / sum(math.exp(x - parts[best]) for x in parts))
    for small in (10**6, 0):
        monkeypatch.setattr(language, "SMALL", small)
        monkeypatch.setattr(language, "COMMON", 4)
        got = {r["k"]: (r["lang_found"], r["lang_score"]) for r in language.fuse(df, model, p).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert [got[k][1] for k in sorted(got)] == pytest.approx([want[k][1] for k in sorted(want)], abs=1e-9)
