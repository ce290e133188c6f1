r"""Secrets, by multipart credential linking.

Candidates are access identifiers, secrets and endpoints. Strong ones (the base rules: assignments, access keys, long
hexadecimal runs) are reported by themselves. Weak ones - short access keys, unlabelled mixed tokens, endpoints - only
where a complementary part (a secret for an identifier or an endpoint, either of these for a secret) stands within
`scope` characters of them: an interval join of a document's candidates, by one sweep over their ends in order.
Parts that overlap are the same text, so they don't complement one another, and a token inside an endpoint or its path is no secret.
Built-in functions only, row by row: nothing is shuffled.

Null text: empty. Repeated rows are scanned each; an empty table gives no rows. Equal spans of a kind count once. Texts are scanned
whole; work grows with a text's length and its candidates. redact() takes any further columns and keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, spans

# The base rules, in their order, as Java patterns for the same matches.
BASE = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
# Weak candidates and the part of a credential that they stand for.
WEAK = {
    "id_weak": ("id", r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{8,15}|ASIA[A-Z0-9]{16})(?![A-Za-z0-9])"),
    "key_weak": ("secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,64}+={0,2}+(?![A-Za-z0-9+/_=-])"),
    "endpoint": ("endpoint", r"(?<![A-Za-z0-9.-])(?:[a-z][a-z0-9+]{1,15}+://[A-Za-z0-9._~:@%-]{3,200}+|[a-z0-9-]{1,63}+\.(?:s3|sts|ec2|rds)\.amazonaws\.com)[^\s\"'<>?#]*+"),
}
ENDPOINT = r"^(?:[a-z][a-z0-9+]+://[A-Za-z0-9._~:@%-]+|[a-z0-9-]+\.(?:s3|sts|ec2|rds)\.amazonaws\.com)"  # without its path
STRONG_PART = {"assign": "secret", "access": "id", "hex": "secret"}
PARTS = ("id", "secret", "endpoint")
SCOPE = 200
BLOCK = 4096


FOUND = "array<struct<start: bigint, rank: int, kind: string, end: bigint, part: string, strong: boolean>>"


def candidates(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """_row (the carried columns), _text and found: FOUND; base rules filtered as they say."""
    t = F.col("_text")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), common.whole(F.col(text)).alias("_text"))
    guard = {
        "assign": F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")),
        "access": F.contains(t, F.lit("AKIA")),
        "id_weak": F.contains(t, F.lit("AKIA")) | F.contains(t, F.lit("ASIA")),
        "endpoint": F.contains(t, F.lit("://")) | F.contains(t, F.lit(".amazonaws.com")),
        "hex": t.rlike("[0-9a-f]{24}"),
        "key_weak": t.rlike("[A-Za-z0-9+/_-]{20}"),
    }
    patterns = BASE | {k: p for k, (_, p) in WEAK.items()}
    df = spans.find(df, "_text", {f"_{k}": (p, guard[k]) for k, p in patterns.items()}, near=0)
    df = df.withColumn("_assign", F.filter("_assign", lambda s: F.length(F.regexp_extract(s["match"], VALUE, 1)) >= 6))

    def parts(kind: str, rank: int) -> Column:
        part, strong = (STRONG_PART[kind], True) if kind in BASE else (WEAK[kind][0], False)
        end = lambda s: s["start"] + F.length(F.regexp_extract(s["match"], ENDPOINT, 0)) if kind == "endpoint" else s["end"]
        out = F.transform(F.col(f"_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end(s).alias("end"), F.lit(part).alias("part"), F.lit(strong).alias("strong")))
        return out.cast(FOUND)

    df = df.withColumn("_key_weak", F.when((F.size("_key_weak") > 0) & (F.size("_endpoint") > 0), outside("_key_weak", "_endpoint")).otherwise(F.col("_key_weak")))
    return df.select("_row", "_text", F.concat(*[parts(k, n) for n, k in enumerate(patterns)]).alias("found"))


def outside(these: str, those: str) -> Column:
    """The spans of one column that don't begin inside one of another: one walk over both in order of their starts."""
    kind = f"array<struct<start: bigint, own: int, span: {spans.SPAN}>>"
    every = F.array_sort(F.concat(F.transform(those, lambda s: F.struct(s["start"], F.lit(0), s)).cast(kind), F.transform(these, lambda s: F.struct(s["start"], F.lit(1), s)).cast(kind)))

    def clear(e: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        upto = spans.running(F.transform(e, lambda x: F.when(x["own"] == 0, x["span"]["end"]).otherwise(zero)), spans.MOST, zero)
        good = F.filter(F.arrays_zip(e.alias("e"), upto.alias("upto")), lambda x: (x["e"]["own"] == 1) & (x["e"]["start"] >= x["upto"]))
        return F.transform(good, lambda x: x["e"]["span"])

    return common.let(every, clear)


def linked(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """df with `found` cut to the strong candidates, and the weak ones with a complementary part at most `scope` characters before or after them, sorted.

    Two walks over the ends of all spans in order: each start asks for the last end of a complementary part before it, each end for the next start.
    """
    kind = f"array<struct<at: bigint, opens: int, span: {FOUND[6:-1]}>>"
    found, strong = F.col("found"), F.filter("found", lambda s: s["strong"])
    mixed = F.exists(found, lambda s: ~s["strong"]) & F.exists(found, lambda s: s["part"] == "secret") & F.exists(found, lambda s: s["part"] != "secret")
    # ends come before the starts at the same place: spans that touch don't overlap
    events = F.array_sort(F.concat(F.transform(found, lambda x: F.struct(x["end"], F.lit(0), x)).cast(kind), F.transform(found, lambda x: F.struct(x["start"], F.lit(1), x)).cast(kind)))
    ahead, behind = F.lit(1 << 40), F.lit(-(1 << 40))

    def near(e: Column) -> Column:
        places = lambda opens, secret, other: F.transform(e, lambda x: F.when((x["opens"] == opens) & ((x["span"]["part"] == "secret") == secret), x["at"]).otherwise(other))
        last = {k: spans.running(places(0, k, behind), spans.MOST, behind) for k in (True, False)}
        following = {k: F.reverse(spans.running(F.reverse(places(1, k, ahead)), spans.LEAST, ahead)) for k in (True, False)}
        zipped = F.arrays_zip(e.alias("e"), last[True].alias("last_secret"), last[False].alias("last_other"), following[True].alias("next_secret"), following[False].alias("next_other"))

        def hit(x: Column) -> Column:
            at, secret = x["e"]["at"], x["e"]["span"]["part"] == "secret"
            before, after = F.when(secret, x["last_other"]).otherwise(x["last_secret"]), F.when(secret, x["next_other"]).otherwise(x["next_secret"])
            return F.when(x["e"]["opens"] == 1, at - before <= scope).otherwise(after - at <= scope) & ~x["e"]["span"]["strong"]

        return F.transform(F.filter(zipped, hit), lambda x: x["e"]["span"])

    weak = F.when(mixed, common.let(events, near)).otherwise(F.array().cast(FOUND))
    return df.withColumn("found", spans.distinct(F.concat(strong, weak)))


def detect(docs: DataFrame, scope: int = SCOPE, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and `found`, with linked weak candidates; a row for each row of docs."""
    return candidates(docs, [c for c in carry if c != "found"]).transform(lambda d: linked(d, scope)).select("_row.*", "found")


def report(docs: DataFrame) -> DataFrame:
    df = detect(docs.select("doc_id", "text"))
    slim = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
    strong = F.transform(F.filter("found", lambda s: s["strong"]), slim)
    every = spans.distinct(F.transform("found", slim))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *[count(k) for k in BASE], F.sha2(spans.listing(strong), 256).alias("base_sha256"), spans.listing(every).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The same columns; the text of every reported secret and access key is replaced by a mark. Endpoints stay. Spans that overlap become one mark."""
    df = linked(candidates(docs, docs.columns), scope)
    df = df.withColumn("_cut", F.transform(F.filter("found", lambda s: s["part"] != "endpoint"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    zero = F.lit(0).cast("bigint")
    upto = spans.running(F.transform("_cut", lambda s: s["end"]), spans.MOST, zero)
    df = df.withColumn("_upto", upto).withColumn("_blocks", F.when(F.size("_cut") > 0, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def between(blocks: Column, start: Column, end: Column) -> Column:
        """A piece of the text, from the blocks that hold it: a place in a long string is only found by reading all before it."""
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        return F.substr(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))

    def joined(row: Column) -> Column:
        starts = F.concat(F.transform(row["cut"], lambda s: s["start"]), F.array(F.length("_text").cast("bigint")))
        gaps = F.filter(F.arrays_zip(starts.alias("to"), F.concat(F.array(zero), row["upto"]).alias("from")), lambda x: x["to"] >= x["from"])
        return F.array_join(F.transform(gaps, lambda x: between(row["blocks"], x["from"], x["to"])), mark)

    whole = common.let(F.struct(F.col("_cut").alias("cut"), F.col("_upto").alias("upto"), F.col("_blocks").alias("blocks")), joined)
    text = F.when(F.size("_cut") > 0, whole).otherwise(F.col("_row.text"))
    return df.select(*[text.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
