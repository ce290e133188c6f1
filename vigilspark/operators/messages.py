"""Synthesised messages: templates and slots chosen by integer arithmetic over events, so that any SQL engine builds the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalogue as cat
from .templates import CLOSERS, OPENERS, SLOTS, TEMPLATES


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.lit(values), (index % len(values) + 1).cast("int"))


def from_events(events: DataFrame) -> DataFrame:
    """msg_id, ts, channel, text, label, category, template_id; one message for each event. Slots are filled first, then the text gets its frame."""
    e, u = F.col("event_id"), F.col("user_id")
    t = e * 31 + 7
    text = pick([x for _, _, x in TEMPLATES], t)
    for k, (slot, values) in enumerate(SLOTS.items()):
        text = F.replace(text, F.lit("{" + slot + "}"), pick(values, u * 17 + e * (k + 1)))
    df = events.select(
        e.alias("msg_id"), "ts", F.col("event_type").alias("channel"), text.alias("text"), pick(OPENERS, u * 13 + e * 5).alias("_opener"), pick(CLOSERS, u * 7 + e * 11).alias("_closer"), ((e + u) % 4 == 0).alias("_plain"),
        pick([a for a, _, _ in TEMPLATES], t).cast("int").alias("label"), pick([c for _, c, _ in TEMPLATES], t).alias("category"), F.concat(F.lit("T"), (t % len(TEMPLATES)).cast("string")).alias("template_id"),
    )
    df = df.withColumn("text", framed(F.col("text"), F.col("_opener"), F.col("_closer")))
    return df.withColumn("text", F.when(F.col("_plain"), F.translate("text", *accents())).otherwise(F.col("text"))).drop("_opener", "_closer", "_plain")


#: Endings after which nothing more is said.
CLOSED = "(?:" + "|".join(cat.ENDINGS) + ")[ .!?]*$"


def framed(text: Column, opener: Column, closer: Column) -> Column:
    """An opener before the text, whose first letter becomes small, and closing words after it, unless it ends in such words already."""
    begun = F.when(opener == "", text).otherwise(F.concat(opener, F.lower(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2))))
    return F.when((closer == "") | F.rlike(F.lower(text), F.lit(CLOSED)), begun).otherwise(F.concat(F.regexp_replace(begun, "[ .!]+$", ""), closer))


def accents() -> tuple[str, str]:
    """The accented letters that the templates use and their plain forms, case kept."""
    import unicodedata

    letters = sorted({c for _, _, x in TEMPLATES for c in x} | {c for v in SLOTS.values() for x in v for c in x} | {c for x in [*OPENERS, *CLOSERS] for c in x})
    letters = sorted({x for c in letters for x in (c, c.lower())})
    plain = lambda c: {"đ": "d", "Đ": "D"}.get(c, unicodedata.normalize("NFD", c)[0])
    pairs = [(c, plain(c)) for c in letters if ord(c) < 0x10000 and plain(c) != c]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


def sql(cte: str = "messages") -> str:
    """The same rows as a common table expression."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    at = lambda values, index: f"[{', '.join(quote(v) if isinstance(v, str) else str(v) for v in values)}][({index}) % {len(values)} + 1]"
    t = "event_id * 31 + 7"
    text = at([x for _, _, x in TEMPLATES], t)
    for k, (slot, values) in enumerate(SLOTS.items()):
        text = f"replace({text}, '{{{slot}}}', {at(values, f'user_id * 17 + event_id * {k + 1}')})"
    begun = "CASE WHEN opener = '' THEN filled ELSE concat(opener, lower(substr(filled, 1, 1)), substr(filled, 2)) END"
    framed = f"CASE WHEN closer = '' OR regexp_matches(lower(filled), {quote(CLOSED)}) THEN {begun} ELSE concat(regexp_replace({begun}, '[ .!]+$', ''), closer) END"
    return f"""filled_events AS (SELECT *, {text} AS filled, {at(OPENERS, "user_id * 13 + event_id * 5")} AS opener, {at(CLOSERS, "user_id * 7 + event_id * 11")} AS closer FROM events),
        framed_events AS (SELECT *, {framed} AS framed FROM filled_events),
        {cte} AS (SELECT event_id AS msg_id, ts, event_type AS channel, CASE WHEN (event_id + user_id) % 4 = 0 THEN translate(framed, {quote(accents()[0])}, {quote(accents()[1])}) ELSE framed END AS text,
        CAST({at([a for a, _, _ in TEMPLATES], t)} AS INTEGER) AS label, {at([c for _, c, _ in TEMPLATES], t)} AS category, concat('T', CAST(({t}) % {len(TEMPLATES)} AS VARCHAR)) AS template_id FROM framed_events)"""
