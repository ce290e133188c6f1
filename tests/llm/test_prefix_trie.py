"""The conversation trie against one built turn by turn in memory."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

from vigilspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, part int, name string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [(r, t) for _, _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
        ends[tuple(seq)].add(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        mine = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = mine + sum(saved[x] for x in children[node])
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(str(x) for x in sorted(ends[n])).encode()).hexdigest())
        for n, m in members.items()
    )


def got(spark, rows):
    df = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def key(t):
    return tuple((x is not None, x) for x in t)


def same(spark, rows):
    a, b = sorted(got(spark, rows), key=key) if rows else got(spark, rows), sorted(plain(rows), key=key)
    assert a == b


def made(rnd, convs, turns, words):
    out = []
    for c in convs:
        for t in range(rnd.randint(1, turns)):
            out.append((c, t, rnd.choice(["user", "bot"]), " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, words))), 7, "x"))
    return out


def test_against_plain(spark):
    rnd = random.Random(5)
    for convs, turns, words in ((range(40), 5, 1), (range(0, 600, 7), 4, 2), (range(100, 160), 9, 0)):
        same(spark, made(rnd, convs, turns, words))


def test_copies_longer_ones_and_odd_rows(spark):
    rows = [(c, t, "user", f"turn {t}", 1, "n") for c in range(90) for t in range(3 + c % 4)]
    rows += [(500, None, None, None, 1, "n"), (500, 1, "user", None, 1, "n"), (500, 1, "user", None, 1, "n"), (500, None, "user", "  ", 1, "n"), (None, 0, "user", "lost", 1, "n"), (-3, 0, "user", "minus", 1, "n")]
    rows += [(40, 400 + t, "bot", "x y", 1, "n") for t in range(150)] + [(41, 400 + t, "bot", "x y", 1, "n") for t in range(149)]
    same(spark, rows)


def test_one_conversation_and_none(spark):
    same(spark, [(7, 0, "user", "a b", 1, "n")])
    assert got(spark, []) == []


def test_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 10)
    same(spark, [(c, t, "user", "same" if c % 3 else "other words", 1, "n") for c in range(300) for t in range(2)])


def test_forest_of_parts_is_the_trie_of_the_whole():
    """Sorted sequences cut anywhere: closed nodes are those of the whole."""
    rows = sorted((bytes(16 * [a]) + bytes(16 * [b]), [1, 1], 1, 10 * a + b, "e") for a in range(3) for b in range(3))
    whole = [r for r in prefix_trie.forest(0, rows) if r[0] in ("node", "under")]
    parts = [r for k, part in enumerate((rows[:4], rows[4:])) for r in prefix_trie.forest(k, part) if r[0] in ("node", "under")]
    assert {r[1:3] for r in parts} < {r[1:3] for r in whole}
