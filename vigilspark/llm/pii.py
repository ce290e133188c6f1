r"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Built-in functions only, one pass, no shuffle. Base spans (email, ip, card, phone) follow fixed rules and always stay.
The method adds spans whose score is at least `threshold`: cards inside a longer run of digits, cards with dots (Luhn),
account numbers (mod 97), national phone numbers and social security numbers, the last two only beside a context word.

Null text: empty, no spans. Equal spans of a kind count once. Repeated rows give repeated results; an empty table gives none.
Texts are scanned whole; work grows with a text's length and its matches. Columns of docs that are named like a result give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, spans

# The kinds of the base rules in their order, with Java patterns for the same matches.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What the method adds.
MORE = {
    "card_part": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    "card_dots": r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Score without context, and words that raise it.
SCORES = {
    "email": (0.9, r"(?i)\b(e-?mail|mail|contact|correo|courriel)\b"),
    "ip": (0.7, r"(?i)\b(ip|host|server|address|adresse)\b"),
    "card": (0.8, r"(?i)\b(card|visa|mastercard|credit|tarjeta|carte|karte|cc)\b"),
    "phone": (0.7, r"(?i)\b(phone|tel|call|mobile|cell|fax|telefon|teléfono|téléphone)\b"),
    "iban": (0.9, r"(?i)\b(iban|account|bank|konto|cuenta|compte)\b"),
    "ssn": (0.3, r"(?i)\b(ssn|social|security|tax)\b"),
    "local_phone": (0.3, r"(?i)\b(phone|tel|call|mobile|cell|fax|telefon|teléfono|téléphone)\b"),
}
CONTEXT = 0.3


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes; each second digit from the right counts double, less 9 above 9."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number leaves 1: its first four characters moved to the end, letters as 10 to 35."""
    s = F.regexp_replace(number, " ", "")
    turned = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")
    value = F.transform(turned, lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def confirmed(kind: str) -> Column:
    """The spans of a kind that pass its checks."""
    c, number = F.col(f"_{kind}"), lambda s: digits(s["match"])
    if kind == "ip":
        return F.filter(c, lambda s: F.forall(F.split(s["match"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(4)).cast("int") <= 255)))
    if kind in ("card", "card_part", "card_dots"):
        least = 14 if kind == "card" else 13
        return F.filter(c, lambda s: F.length(number(s)).between(least, 19) & luhn(number(s)))
    if kind == "phone":
        return F.filter(c, lambda s: F.length(number(s)).between(10, 15))
    if kind == "iban":
        return F.filter(c, lambda s: F.length(F.regexp_replace(s["match"], " ", "")).between(15, 34) & mod97(s["match"]))
    if kind == "ssn":
        return F.filter(c, lambda s: ~s["match"].rlike(r"^(000|666|9)|-00-|-0000$"))
    return c


def detect(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base (base spans), all_spans and scored (kind, start, end, score)."""
    added = [*[f"n_{k}" for k in BASE], "base", "scored", "all_spans"]
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    df = docs.select(carried.alias("_row"), common.whole(F.col(text)).alias("_text"))
    # cheap conditions: what a match can't do without
    digit, t = F.col("_text").rlike("[0-9]"), F.col("_text")
    df = df.withColumn("_digit", digit)
    guards = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+")) & F.col("_digit")}
    df = spans.find(df, "_text", {f"_{k}": (p, guards.get(k, F.col("_digit"))) for k, p in (BASE | MORE).items()})
    df = df.select("_row", *[confirmed(k).alias(f"_{k}") for k in BASE | MORE])
    label = {"card_part": "card", "card_dots": "card", "local_phone": "phone"}
    order = {k: n for n, k in enumerate([*BASE, "iban", "ssn"])}

    def scored(kind: str) -> Column:
        shown = label.get(kind, kind)
        base, words = SCORES[kind if kind in SCORES else shown]
        score = lambda s: F.least(F.lit(1.0), F.lit(base) + F.when(F.concat_ws(" ", s["before"], s["after"]).rlike(words), CONTEXT).otherwise(0.0))
        out = F.transform(F.col(f"_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(order[shown]).alias("rank"), F.lit(shown).alias("kind"), s["end"].alias("end"), score(s).alias("score")))
        return out if kind in BASE else F.filter(out, lambda s: s["score"] >= threshold)

    df = df.select(
        "_row",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.concat(*[spans.tagged(F.col(f"_{k}"), k, n) for n, k in enumerate(BASE)]).alias("base"),
        F.array_sort(F.concat(*[scored(k) for k in [*BASE, *MORE]])).alias("scored"),
    )
    plain = F.transform(F.col("scored"), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return df.withColumn("all_spans", spans.distinct(plain)).select("_row.*", *added)


def report(docs: DataFrame) -> DataFrame:
    df = detect(docs.select("doc_id", "text"))
    return df.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(spans.listing(F.col("base")), 256).alias("base_sha256"), spans.listing(F.col("all_spans")).alias("spans"), F.round(F.coalesce(F.array_max(F.transform("scored", lambda s: s["score"])), F.lit(0.0)), 2).alias("top_score"))
