"""Text normalisation as column expressions: folding, de-obfuscation, display forms."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import catalogue as cat

MAX_LENGTH = 2000
ZERO_WIDTH = "​‌‍﻿"
LEET = ("013457@$", "oieastas")
SPACE = r"(?U)[\s\x1c-\x1f]+"


@cache
def fold_table() -> tuple[str, str, str]:
    """(from, to, dropped): what canonical decomposition without combining marks, and lower case, make of each character of the basic plane, Hangul excepted."""
    source, target, dropped = [], [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or unicodedata.category(c) in ("Cs", "Cn", "Co"):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)).lower()
        plain = "".join(x for x in unicodedata.normalize("NFD", plain) if not unicodedata.combining(x)).replace("đ", "d")
        if plain == "":
            dropped.append(c)
        elif plain != c and len(plain) == 1:
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target), "".join(dropped)


def strip(text: Column) -> Column:
    """Without white space at both ends, all of Unicode's."""
    return F.regexp_replace(F.regexp_replace(text, "^" + SPACE, ""), SPACE + "$", "")


def without_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def fold(text: Column) -> Column:
    """Lower case without accents or zero-width characters, white space squeezed."""
    source, target, dropped = fold_table()
    return squeeze(F.lower(F.translate(without_zero_width(text), source + dropped, target)))


def display(text: Column) -> Column:
    """As long as fold(text), place by place, but with case and accents as written."""
    return squeeze(F.translate(without_zero_width(text), fold_table()[2], ""))


def error_code(text: Column, most: int = MAX_LENGTH) -> Column:
    return F.when(text.isNull() | (strip(text) == ""), "EMPTY").when(F.length(text) > most, "TOO_LONG")


def deleet(folded: Column) -> Column:
    """Digits and signs as the letters they stand for, in tokens with at least as many letters as digits, no two digits together and none of : / @."""

    def token(t: Column) -> Column:
        letters, digits = F.regexp_count(t, F.lit(r"(?U)\p{L}")), F.regexp_count(t, F.lit("[0-9]"))
        fits = ~t.rlike("[:/@]") & (letters >= 1) & (digits >= 1) & (letters >= digits) & ~t.rlike("[0-9]{2}")
        return F.when(fits, F.translate(t, *LEET)).otherwise(t)

    return F.array_join(F.transform(F.split(folded, " "), token), " ")


def dense(folded: Column) -> Column:
    return F.regexp_replace(folded, "[^a-z0-9]+", "")


def has_diacritics(text: Column) -> Column:
    """Whether anything changes when accents go, case aside, or there is a đ."""
    source, target, dropped = fold_table()
    low = F.lower(text)
    return F.translate(low, source + dropped, target) != low


def detach(text: Column) -> Column:
    """Punctuation before a space or the end stands by itself."""
    return squeeze(F.regexp_replace(text, r"(?U)([.,!?;:])(?=\s|$)", " $1"))


MARKS = ".,!?;:()[]\"'"


def restore(folded: Column) -> Column:
    """Accents restored from a small lexicon, longest phrases first, then single words; punctuation around a word stays."""
    out = F.concat(F.lit(" "), folded, F.lit(" "))
    for plain, shown in sorted(cat.PHRASES.items(), key=lambda p: -len(p[0].split())):
        for _ in range(2):  # neighbours share the space between them
            out = F.replace(out, F.lit(f" {plain} "), F.lit(f" {shown} "))
    words = F.create_map(*[F.lit(x) for p in cat.LEXICON.items() for x in p])

    def one(t: Column) -> Column:
        core = F.trim(t, F.lit(MARKS))
        before = F.substr(t, F.lit(1), F.position(core, t) - 1)
        after = F.substr(t, F.length(before) + F.length(core) + 1)
        found = F.try_element_at(words, core)
        return F.when((core == "") | found.isNull(), t).otherwise(F.concat(before, found, after))

    return F.array_join(F.transform(F.split(F.trim(out), " "), one), " ")


def normalized(text: Column) -> Column:
    """For display: what has accents in lower case, what has none restored; punctuation detached."""
    return F.when(has_diacritics(text), detach(F.lower(strip(text)))).otherwise(detach(restore(fold(text))))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


# Placeholders of the anonymised data set and what stands for them.
SAMPLES = {
    "[PHONE]": "0987654321", "[BANK_ACC]": "19001234567", "[MONEY]": "500.000d", "[NUMBER]": "123456", "[TIME]": "15:30", "[DATE]": "20/09/2026", "[NAME]": "Nam", "[POINT]": "1000", "[URL]": "http://example.vip/abc",
}


def rehydrate(text: Column) -> Column:
    """Placeholders become samples; of any other tag in capitals the brackets go."""
    out = text
    for tag, sample in SAMPLES.items():
        out = F.replace(out, F.lit(tag), F.lit(sample))
    return F.regexp_replace(out, r"\[([A-Z_]{1,20})\]", "$1")


def for_model(text: Column) -> Column:
    return deleet(fold(text))


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once inside an expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def distinct_ignoring_case(values: Column) -> Column:
    """The first of values that differ only by case, in order."""
    return let(values, lambda v: let(F.transform(v, lambda x: F.lower(x)), lambda low: F.filter(v, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def running(values: Column) -> Column:
    """Of an array of numbers, the sum up to each place. Sums of blocks, and of blocks of blocks, keep the work for a place to a few blocks; gathering the sums one by one would copy them at each place."""
    zero = F.lit(0).cast("bigint")
    total = lambda a: F.aggregate(a, zero, lambda x, y: x + y)
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.shiftright(F.size(a) - 1, 6), F.lit(0))), lambda k: total(F.slice(a, k * 64 + 1, F.lit(64))))

    def upto(v: Column, one: Column, two: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            far, near = F.shiftright(i, 12), F.shiftright(i, 6)
            return total(F.slice(two, F.lit(1), far)) + total(F.slice(one, far * 64 + 1, near - far * 64)) + total(F.slice(v, near * 64 + 1, i - near * 64 + 1))

        return F.transform(v, at)

    return let(values, lambda v: let(blocks(v), lambda one: let(blocks(one), lambda two: upto(v, one, two))))


#: A sign that no folded text has: capitals are gone.
MARK = "A"


def marked(folded: Column, pattern: str) -> Column:
    """The text with a mark before and after each match. A literal pattern is compiled once."""
    return F.regexp_replace(folded, "(?U)" + pattern, f"{MARK}$0{MARK}")


def between_marks(text: Column, shown: Column) -> Column:
    """What stands between the marks as it is written in `shown`, spaces at both ends cut off: the places come from the lengths of all parts."""

    def cut(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda x: F.length(x).cast("bigint")))
        both = F.arrays_zip(parts.alias("x"), ends.alias("e"))
        inner = F.filter(both, lambda _, i: i % 2 == 1)
        return F.transform(inner, lambda x: F.trim(F.substr(shown, (x["e"] - F.length(x["x"]) + 1).cast("int"), F.length(x["x"]))))

    def few(parts: Column) -> Column:
        """The same for one match, which most have."""
        return F.array(F.trim(F.substr(shown, F.length(F.get(parts, F.lit(0))) + 1, F.length(F.get(parts, F.lit(1))))))

    none = F.array().cast("array<string>")
    return let(F.split(text, MARK, -1), lambda p: F.when(F.size(p) == 1, none).when(F.size(p) == 3, few(p)).otherwise(cut(p)))


def spans(folded: Column, shown: Column, pattern: str) -> Column:
    """All matches of a pattern in the folded text as they are written, spaces at both ends cut off."""
    return let(shown, lambda d: between_marks(marked(folded, pattern), d))


def index_map(text: Column) -> Column:
    """array<int>: for each place of fold(text) the place in `text` that it comes from, both from 0.

    Zero-width characters and combining marks have no place in the folded text, white space counts once where it is squeezed, and not at all at the ends.
    """
    source, target, dropped = fold_table()
    chars = F.transform(F.split(text, ""), lambda c: c)
    gone = f"[{ZERO_WIDTH}]"
    plain = lambda c: F.translate(c, dropped, "")
    # (place, kind): 0 nothing, 1 white space, 2 anything else
    kinds = F.filter(F.transform(chars, lambda c, i: F.struct(i.alias("at"), F.when(c.rlike(gone) | (plain(c) == ""), 0).when(c.rlike(SPACE), 1).otherwise(2).alias("kind"))), lambda x: x["kind"] > 0)
    kept = lambda k: F.filter(k, lambda x, i: (x["kind"] == 2) | ((i > 0) & (F.get(k, i - 1)["kind"] == 2)))
    ends = lambda k: F.when((F.size(k) > 0) & (F.element_at(k, -1)["kind"] == 1), F.slice(k, F.lit(1), F.size(k) - 1)).otherwise(k)
    return F.transform(let(let(kinds, kept), lambda k: F.when(F.size(k) > 0, ends(k)).otherwise(k)), lambda x: x["at"])


def original_span(text: Column, places: Column, start: Column, end: Column) -> Column:
    """What `text` has where the folded text has the places from start up to end (from 0), by an index_map; marks that follow the last character belong to it."""
    first = F.get(places, start.cast("int"))
    after = F.coalesce(F.get(places, end.cast("int")), F.length(text))
    return F.trim(F.substr(text, first + 1, after - first))
