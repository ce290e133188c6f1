"""Words that a rule's patterns can't match without, so that only rules whose words occur run their expressions."""

from __future__ import annotations

from re import _parser, error
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 4000  # ways through a pattern that are looked at
EDGE, ANY = object(), object()  # a word boundary; something that isn't known


def _ways(node) -> list[list]:
    """Every way through a parsed pattern, as characters, EDGE and ANY."""
    out: list[list] = [[]]
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            some = [[chr(arg)]]
        elif name == "AT":
            some = [[EDGE]] if str(arg) == "AT_BOUNDARY" else [[]]
        elif name == "SUBPATTERN":
            some = _ways(arg[-1])
        elif name == "BRANCH":
            some = [w for branch in arg[1] for w in _ways(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
            some = _ways(arg[2]) + ([[]] if arg[0] == 0 else [])
        else:
            some = [[ANY]]
        out = [a + b for a in out for b in some]
        if len(out) > MOST:
            raise OverflowError
    return out


def _word(way: list) -> str | None:
    """The longest word of a way with an end on either side."""
    best, run, begun = None, "", False
    for x in [*way, ANY]:
        if isinstance(x, str) and x.isascii() and x.isalnum():
            run += x
            continue
        ends = x is EDGE or (isinstance(x, str) and x.isascii())
        if begun and ends and run and (best is None or len(run) > len(best)):
            best = run
        run, begun = "", ends
    return best


@cache
def words(patterns: tuple[str, ...]) -> frozenset[str] | None:
    """Words of which any match of any pattern has one as a whole; None where there are none such."""
    found = set()
    try:
        for p in patterns:
            for way in _ways(_parser.parse(p)):
                w = _word(way)
                if w is None:
                    return None
                found.add(w)
    except (OverflowError, error):
        return None
    return frozenset(found)


def present(text: Column, wanted: list[str]) -> Column:
    """Those of the wanted words that a text in small letters has as whole words."""
    return F.array_intersect(F.lit(wanted), F.split(text, "[^a-z0-9]+", -1))
