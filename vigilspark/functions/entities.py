"""Entities of a message as arrays: links, phone numbers, mail addresses, amounts, accounts, mentions of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

# What counts as an entity.
URL = r"(?:https?://|www\.)[^\s<>\"'()\[\]]+|(?<![@\w.])[a-z0-9][a-z0-9-]{1,40}(?:\.[a-z0-9-]{1,30})*\.(?:com|vn|net|org|edu|gov|info|biz|vip|xyz|top|club|online|site|shop|store|icu|tk|ml|ga|gq|cf|buzz|win|me|io|co|app|link|fun|live)(?:/[^\s<>\"'()\[\]]*)?"
PHONE = r"(?<!\w)(?:\+?84|0)(?:[\s.-]?\d){8,10}(?!\w)"
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
MONEY = r"(?<!\w)\d{1,3}(?:[.,]\d{3})*\s*(?:k|nghin|ngan|tram|trieu|triệu|tr|ty|vnd|vnđ|dong|đồng|d\b|đ\b)|(?<!\w)\d+\s*(?:k|nghin|ngan|trieu|tr|ty)(?!\w)"
ACCOUNT = r"(?<!\w)\d{9,16}(?!\w)"
OTP = r"\b(?:otp|ma xac minh|ma xac nhan|ma bao mat|mat khau|password|pass)\b"
KINDS = ["urls", "phone_numbers", "emails", "money_amounts", "bank_accounts", "otp_mentions"]


def every(c: Column, pattern: str, flags: str = "(?iuU)") -> Column:
    return tx.distinct_ignoring_case(F.regexp_extract_all(c, F.lit(flags + pattern), F.lit(0)))


def urls(text: Column) -> Column:
    return every(text, URL)


def phones(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + PHONE), F.lit(0))
    return tx.distinct_ignoring_case(F.transform(found, lambda p: F.regexp_replace(p, r"[\s.\-]", "")))


def emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), every(text, EMAIL)).otherwise(F.array().cast("array<string>"))


def amounts(text: Column) -> Column:
    return tx.distinct_ignoring_case(F.transform(F.regexp_extract_all(text, F.lit("(?iuU)" + MONEY), F.lit(0)), lambda x: F.trim(x)))


def accounts(text: Column, phone_numbers: Column) -> Column:
    found = every(text, ACCOUNT, "(?U)")
    return F.filter(F.array_except(found, phone_numbers), lambda a: ~F.startswith(a, F.lit("0")))


def otp_mentions(folded: Column) -> Column:
    return every(folded, OTP)


def extract(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct `entities`; built in steps, so that nothing is evaluated twice."""
    t = F.col(text)
    df = df.withColumn("_phones", phones(t)).withColumn("_folded", tx.deleet(tx.fold(t)))
    parts = [urls(t), F.col("_phones"), emails(t), amounts(t), accounts(t, F.col("_phones")), otp_mentions(F.col("_folded"))]
    return df.withColumn("entities", F.struct(*[p.alias(k) for k, p in zip(KINDS, parts, strict=True)])).drop("_phones", "_folded")


def long_form(df: DataFrame, key: str) -> DataFrame:
    """(key, kind, value) of all entities."""
    each = F.flatten(F.array(*[F.transform(F.col(f"entities.{k}"), lambda v, k=k: F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k in KINDS]))
    return df.select(key, F.explode(each).alias("e")).select(key, "e.*")


def merged(own: Column, given: Column) -> Column:
    """The entities of a message and those that a caller supplies, kind by kind: own ones first, what differs only by case once. A missing kind is an empty one."""
    none = F.array().cast("array<string>")
    return F.struct(*[tx.distinct_ignoring_case(F.concat(F.coalesce(own[k], none), F.coalesce(given[k], none))).alias(k) for k in KINDS])
