import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilspark.operators import advice, evaluation, messages, scoring, splits
from vigilspark.operators import catalogue as cat
from vigilspark.plans import registry

SF = "/root/testdata/sf0.001"
DANGEROUS = [
    "Thầy Dũng dạy Nhạc đây, đàn hỏng giữa buổi diễn, mua giúp thầy 2 thẻ Viettel 300k gấp.",
    "thay dung day nhac day, dan hong giua buoi dien, mua giup thay 2 the viettel 300k gap.",
    "Tao có ảnh nóng rồi, nạp 3 triệu trước 9h không thì tao gửi lên mạng.",
    "Đọc lại mã OTP cho chị để nhận giải thưởng iPhone ở http://qua-tang-vip.club/nhan",
]
SAFE = ["Chiều nay nhóm mình làm bài tập Sinh ở thư viện, bạn mang sách giáo khoa nha.", "Bà nấu cháo rồi, con đi học về ăn liền cho nóng.", "Lịch ôn tập nằm trên https://hocmai.vn, các bạn mở ra xem.", "toi nay lop minh da bong o san truong, may gio toi"]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(k, t) for k, t in enumerate([*DANGEROUS, *SAFE, None, ""])]
    df = scoring.score(spark.createDataFrame(rows, "msg_id int, text string"))
    return {r["msg_id"]: r for r in df.collect()}


def test_levels(verdicts):
    assert [verdicts[k]["level"] for k in range(8)] == ["DANGEROUS"] * 4 + ["SAFE"] * 4


def test_evidence_is_verbatim(verdicts):
    for k, text in enumerate(DANGEROUS):
        assert verdicts[k]["evidence"] and all(e["phrase"] in text for e in verdicts[k]["evidence"])
    assert all(not verdicts[4 + k]["evidence"] for k in range(4))


def test_bad_rows_are_not_judged(verdicts):
    assert set(verdicts) == set(range(8))


def test_score_by_hand(verdicts):
    for v in verdicts.values():
        if v["rule_hits"] is None:
            continue
        left = 1.0
        for w in [h["weight"] for h in v["risk"]] + [c["boost"] for c in v["combos"]]:
            left *= 1 - w
        if v["hard"]:
            assert v["score"] == pytest.approx(max(0.85, 1 - left), abs=1e-4)


def test_advice(spark):
    df = spark.createDataFrame([("DANGEROUS", "OTP_PHISHING"), ("SUSPICIOUS", "SAFE"), ("ODD", "X")], "level string, category string")
    r = advice.advise(df, F.lit("a")).collect()
    assert [x["block"] for x in r] == ["OTP_PHISHING", "GENERIC_CAUTION", "SAFE"] and len(r[0]["steps"]) == 6 and r[2]["error_code"] == "BAD_LEVEL"


def test_catalogue():
    assert len(cat.RULES) == 37 and sum(len(r.patterns) for r in cat.RULES) >= 125 and len(cat.COMBOS) == 9 and {r.signal for r in cat.RULES} <= set(cat.SIGNALS)


QUICK = ["b3_b4_fold_documents", "d5_d9_gates_combos", "e5_e13_e17_host_facts", "f1_f6_f11_f12_scores", "g6_grading", "i3_stratified", "j9_mean_p95_max", "l1_stream_scores", "a3_a4_csv_records", "a6_a9_a10_blocklist_file", "a10_blocklist_head", "a13_blocklist_export", "g5_g8_category_cards", "i2_group_split", "j7_report_by_source", "k1_k2_k5_generate", "k4_k8_buckets"]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(json.dumps([r[c] for c in cols], default=str) for r in df.collect())
    other = con.sql(registry.oracle_sql()[name])
    at = [other.columns.index(c) for c in cols]
    assert mine == sorted(json.dumps([r[k] for k in at], default=str) for r in other.fetchall())


def test_p95_of_odd_tables(spark):
    for values in ([], [None], [3.5], [1.0, 2.0], [float(k % 977) for k in range(5000)], [2.0] * 40 + [9.0] * 2):
        r = evaluation.mean_p95_max(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
        known = sorted(v for v in values if v is not None)
        assert (r["p95"], r["max"]) == ((known[max(1, int(0.95 * len(known))) - 1], known[-1]) if known else (None, None))


def test_rows_without_a_group_are_split_by_id(spark):
    rows = [(k, None if k % 2 else f"g{k % 10}") for k in range(200)]
    out = splits.by_group(spark.createDataFrame(rows, "id long, g string"), "g", 0.2, "id").collect()
    assert len(out) == 200 and sum(r["part"] == "test" for r in out if r["g"] is None) in range(15, 27)
    assert all(len({r["part"] for r in out if r["g"] == g}) == 1 for g in ("g0", "g2", "g4", "g6", "g8"))


def test_closing_words_are_not_doubled(spark):
    cases = [("Đi học đi.", " nhé.", "Này, đi học đi nhé."), ("Đi học nha!", " nhé.", "Này, đi học nha!"), ("ĐI HỌC NHÉ BẠN ...", " ạ.", "Này, đI HỌC NHÉ BẠN ..."), ("Đi học", "", "Này, đi học")]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, c string")
    assert [r[0] for r in df.select(messages.framed(F.col("t"), F.lit("Này, "), F.col("c"))).collect()] == [c[2] for c in cases]
    assert df.select(messages.framed(F.col("t"), F.lit(""), F.lit(""))).first()[0] == "Đi học đi."
