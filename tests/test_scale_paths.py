"""Paths for large lists against the plain ones: literal index, blocklist tables, deletions, quarantine, catalogues from tables, index maps, layers, versions in a stream."""

import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import links as lk
from vigilspark.functions import text as tx
from vigilspark.operators import catalogue as cat
from vigilspark.operators import literals, scoring
from vigilspark.plans import registry
from vigilspark.sources import io
from vigilspark.streaming import stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def msgs(spark):
    return registry.msgs(spark, SF).cache()


def test_every_match_has_a_word_of_its_rule():
    rnd = random.Random(1)
    for r in cat.RULES:
        need = literals.words(r.patterns)
        assert need is None or need
        for p in r.patterns:
            one = literals.words((p,))
            for way in rnd.sample(ways := literals._ways(literals._parser.parse(p)) if one is not None else [], min(30, len(ways))):
                text = "".join("ngay" if x is literals.ANY else "" if x is literals.EDGE else x for x in way)
                if re.search(p, text):
                    assert set(re.split("[^a-z0-9]+", text)) & one, (p, text)


@pytest.mark.parametrize(("pattern", "want"), [(r"\bnap (?:ho|giup)\b", {"nap", "giup"}), (r"nap\b", None), (r"\bx[a-z]+\b", None), (r"\bmini ?game\b", {"mini", "minigame"}), (r"\.(?:apk|exe)\b", {"apk", "exe"}), (r"(", None)])
def test_words_of_patterns(pattern, want):
    assert literals.words((pattern,)) == want


def test_scan_with_and_without_the_index(spark, msgs, monkeypatch):
    texts = msgs.select("msg_id", "text").unionByName(spark.createDataFrame([(-k, f"{a} {w}{b}") for k, (a, w, b) in enumerate(((x, y, z) for x in ("", "é", "_") for y in ("nap ho", "trung thuong", "gap") for z in ("", "ß", "!")), 1)], "msg_id long, text string"))
    rows = lambda: {(r["msg_id"], r["h"]) for r in scoring.scan(scoring.prepare(texts)).select("msg_id", F.to_json("rule_hits").alias("h")).collect()}
    indexed = rows()
    monkeypatch.setattr(literals, "words", lambda patterns: None)
    monkeypatch.setattr(literals, "present", lambda text, wanted: F.array().cast("array<string>"))
    assert rows() == indexed


def test_blocklist_table_is_the_list(spark, msgs):
    """20,000 domains and more, some of them in messages, by broadcast and by hash."""
    hosts = ["vuonrau.example.org", "tiemhoa.shop", "lazada-uudai.top", "cutt.ly"]
    table = spark.range(20_001).select(F.concat(F.lit("host"), F.col("id"), F.lit(".example.com")).alias("domain")).unionByName(spark.createDataFrame([(h,) for h in hosts], "domain string"))
    m = msgs.unionByName(msgs.limit(1).select(*[F.lit("Xem a.host7.example.com và b.tiemhoa.shop/x.apk, bit.ly, tiemhoa.shop, olm.vn").alias(c) if c == "text" else F.col(c) for c in msgs.columns]))
    plain = scoring.score(m, blocked=[*hosts, "host7.example.com"]).select("msg_id", "text", "score", "level", F.to_json("hits").alias("hits")).collect()
    rows = sorted((tuple(r) for r in plain), key=str)
    assert sorted((tuple(r) for r in scoring.score(m, blocked=table).select("msg_id", "text", "score", "level", F.to_json("hits").alias("hits")).collect()), key=str) == rows
    judged = scoring.scan_links_by_host(scoring.scan(scoring.prepare(m)), table, small=0)
    assert sorted(str(r[0]) for r in judged.select(F.to_json("link_hits")).collect()) == sorted(str(r[0]) for r in scoring.scan_links(scoring.prepare(m), blocked=[*hosts, "host7.example.com"]).select(F.to_json("link_hits")).collect())


def test_typos_by_deletions_are_those_of_the_theta_join(spark):
    rnd = random.Random(3)
    brands = ["viettel", "garena", "lazada", "abcdefgh", "shopee", "aaaaa", "zzzzzz"]

    def bent(w):
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randint(0, len(w))
            w = rnd.choice([w[:k] + rnd.choice("abz") + w[k:], w[:k] + w[k + 1 :], w[:k] + rnd.choice("xyz") + w[k + 1 :]])
        return w or "a"

    hosts = spark.createDataFrame([(f"{bent(rnd.choice(brands))}.com",) for _ in range(400)] + [("xn--a.b.c.com",), ("",)], "host string").distinct()
    b = spark.createDataFrame([(x,) for x in brands], "brand string")
    got = lk.typo_pairs(hosts, b)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    d = F.levenshtein("label", "brand", 2)
    h = hosts.withColumn("label", lk.flat_label(F.col("host")))
    theta = h.crossJoin(b).where((F.length("label") >= 5) & (d >= 0) & ~F.contains("label", "brand")).select("host", "brand", d.cast("long").alias("distance"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, theta.collect())) and theta.count() > 50
    facts = lk.host_facts(hosts, None, b).select("host", "typo").collect()
    assert len(facts) == hosts.count() and {r["host"] for r in facts if r["typo"]} == {r["host"] for r in theta.collect()}


def test_quarantine(spark):
    rows = [(1, "fine"), (2, None), (3, "  \u00a0"), (4, "x" * 2001), (5, "x" * 2000), (1, "fine")]
    good, bad, seen = scoring.quarantine(spark.createDataFrame(rows, "id int, text string"))
    assert good.columns == ["id", "text"] and sorted(r["id"] for r in good.collect()) == [1, 1, 5]
    assert sorted((r["id"], r["error_code"]) for r in bad.collect()) == [(2, "EMPTY"), (3, "EMPTY"), (4, "TOO_LONG")]
    assert seen == {"OK": 3, "EMPTY": 2, "TOO_LONG": 1}
    assert scoring.score(spark.createDataFrame(rows, "id int, text string")).count() == 3


def test_knowledge_from_tables(spark):
    tables = io.dims(spark)
    known = io.knowledge(tables)
    assert known.rules == cat.RULES and [c[:2] for c in known.combos] == [c[:2] for c in cat.COMBOS] and known.suppress == cat.SUPPRESS
    assert known.rule("OTP_REQUEST").signal == "OTP" and {r.signal for r in known.by_signal("SAFE")} == {"SAFE"}
    odd = spark.createDataFrame([("NOBODY", 0, "x")], tables["rule_patterns"].schema)
    with pytest.raises(ValueError, match="NOBODY"):
        io.knowledge(tables | {"rule_patterns": tables["rule_patterns"].unionByName(odd)})
    rule = spark.createDataFrame([(99, "OWN", "OTP", "OTP_PHISHING", 0.9, "says zebra", True, False, False)], tables["rules"].schema)
    own = spark.createDataFrame([("OWN", 0, r"\\bzebra\\b".replace("\\\\", "\\"))], tables["rule_patterns"].schema)
    more = io.knowledge(tables | {"rules": tables["rules"].unionByName(rule), "rule_patterns": tables["rule_patterns"].unionByName(own)})
    df = spark.createDataFrame([(1, "a Zebra came")], "msg_id int, text string")
    before, after = scoring.score(df).first(), scoring.score(df, knowledge=more).first()
    assert before["level"] == "SAFE" and after["level"] == "DANGEROUS" and after["highlights"] == ["Zebra"]


ODD = ["Nạp hộ", "  Đường\u200b dài\t\nquá ", "a\u0301b \u0301 c", "x \ufeff y", "", "   ", "한글 테스트", "😀 Tôi 😀", "é\u0302\u0303z"]


def test_index_map(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for text, r in zip(ODD, df.select(tx.fold(F.col("t")).alias("f"), tx.index_map(F.col("t")).alias("m")).collect(), strict=True):
        assert len(r["m"]) == len(r["f"]), text
        for place, c in zip(r["m"], r["f"], strict=True):
            plain = "".join(x for x in unicodedata.normalize("NFD", text[place]) if not unicodedata.combining(x)).lower().replace("đ", "d")
            assert c == " " and text[place].isspace() or c == plain or c == text[place]
        assert r["m"] == sorted(set(r["m"]))


def test_original_span(spark):
    text = "x  Nạ\u0323p\u200b  hộ thầy "
    df = spark.createDataFrame([(text,)], "t string")
    at = tx.fold(F.col("t"))
    r = df.select(at.alias("f"), tx.original_span(F.col("t"), tx.index_map(F.col("t")), F.instr(at, "nap") - 1, F.instr(at, "nap") + 5).alias("s")).first()
    assert r["f"] == "x nap ho thay" and r["s"] == "Nạ\u0323p\u200b  hộ"


def test_spans_in_linear_time(spark):
    df = spark.createDataFrame([("Ab 12k. " * 10_000,)], "t string")
    began = time.time()
    s = df.select(tx.spans(tx.fold(F.col("t")), tx.display(F.col("t")), "[a-z]+ [0-9]+k").alias("s")).first()["s"]
    assert s == ["Ab 12k"] * 10_000 and time.time() - began < 30


def test_engine_label(spark):
    df = spark.createDataFrame([(1, (0.1, 0.1, 0.8), None), (2, None, (0.1, 0.1, 0.8)), (3, None, None), (4, (0.9, 0.1, 0.0), (0.1, 0.1, 0.8))], "k int, a struct<safe: double, suspicious: double, dangerous: double>, b struct<safe: double, suspicious: double, dangerous: double>")
    assert [r[0] for r in df.select(scoring.engine_label("a", "b")).collect()] == ["rules+ml", "rules+external", "rules", "rules+ml+external"]


def test_two_layers_at_once_by_hand(spark):
    layer = "struct<safe: double, suspicious: double, dangerous: double>"
    a, b = (0.1, 0.2, 0.7), (0.05, 0.05, 0.9)
    df = scoring.score(spark.createDataFrame([(1, "hello there", a, b), (2, "hello there", None, b), (3, "hello there", a, None)], f"msg_id int, text string, ml {layer}, ex {layer}"), ml="ml", external="ex")
    got = {r["msg_id"]: r["score"] for r in df.collect()}
    ra, rb = 0.7 + 0.45 * 0.2, 0.9 + 0.45 * 0.05
    want = {1: (0.35 * ra + 0.5 * rb) / (0.65 + 0.35 + 0.5), 2: 0.5 * rb / 1.15, 3: 0.35 * ra / 1.0}
    for k, x in want.items():
        floor = 0.31 if k != 3 else 0.0
        assert got[k] == pytest.approx(max(x, floor), abs=1e-4)


def test_stream_takes_the_newest_lists(spark, tmp_path):
    for name, df in io.dims(spark).items():
        df.write.parquet(f"{tmp_path}/rules/r1/{name}")
    text = "Mở thử trang.example.net"
    parts = [spark.createDataFrame([(k, "2024-01-01", "sms", t) for k, t in rows], "msg_id long, ts string, channel string, text string") for rows in ([(1, text), (2, None)], [(3, text)])]
    for version, part, domains in (("v1", parts[0], ["other.example.com"]), ("v2", parts[1], ["trang.example.net"])):
        spark.createDataFrame([(d,) for d in domains], "domain string").write.parquet(f"{tmp_path}/lists/{version}")
        part.write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # a run without anything new writes nothing
            stream.score_batches(stream.read(spark, f"{tmp_path}/in", part.schema), f"{tmp_path}/lists", f"{tmp_path}/rules", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r["msg_id"]: (r["level"], r["blocklist"], r["rules"]) for r in spark.read.parquet(f"{tmp_path}/out/good").collect()}
    assert got[1][1:] == ("v1", "r1") and got[3] == ("DANGEROUS", "v2", "r1") and got[1][0] != "DANGEROUS" and len(got) == 2
    assert [(r["msg_id"], r["error_code"]) for r in spark.read.parquet(f"{tmp_path}/out/bad").collect()] == [(2, "EMPTY")]
