import math
import random
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import pytest

from vigilspark.llm import suffix_model


def plain_scores(rows, depth):
    """Every listed run is in one Tree, by the same tests, from plain counts."""
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    texts = {k: ["<s>", *[w.decode() for w in suffix_model.words(t)], "</s>"] for k, t in rows}
    runs = [Counter() for _ in range(depth + 2)]
    for k, t in texts.items():
        for size in range(1, depth + 2):
            runs[size].update(() if held[k] else (tuple(t[i : i + size]) for i in range(len(t) - size + 1)))
    kinds = {w: n for n, (w,) in enumerate(sorted({*runs[1], *((x,) for t in texts.values() for x in t)}))}
    n_all, n_kinds = sum(n for (w,), n in runs[1].items() if w != "<s>"), len(runs[1]) - 1
    prob = {w: (runs[1][w,] + 1) / (n_all + n_kinds + 1) for w in kinds}
    base = len(kinds)
    code = lambda c: sum(kinds[w] * base**n for n, w in enumerate(reversed(c)))
    levels = []
    for size in range(1, depth + 1):
        by = {}
        for r, n in runs[size + 1].items():
            if n >= 2:
                by.setdefault(r[:-1], {})[r[-1]] = n
        own = {}
        for c, counts in by.items():
            total = runs[size][c]
            q = {w: prob[w] if size == 1 else runs[size][(*c[1:], w)] / runs[size - 1][c[1:]] for w in counts}
            rest = max(0.0, 1 - sum(counts.values()) / total)
            kl = sum(n / total * math.log(n / total / q[w]) for w, n in counts.items()) + (rest * math.log(rest / max(1e-9, 1 - sum(q.values()))) if rest > 0 else 0)
            if kl * total >= suffix_model.GAIN:
                own[code(c)] = (total, {kinds[w]: n for w, n in counts.items()})
        levels.append(own)
    tree = suffix_model.Tree(levels, base, {kinds[w]: p for w, p in prob.items()})
    adjust = lambda t, i: tree.adjust(code(t[max(0, i - depth) : i]), min(depth, i), kinds[t[i]])
    return {k: sum(math.log10(prob[t[i]]) + adjust(t, i) for i in range(1, len(t))) for k, t in texts.items()}


@pytest.mark.parametrize("depth", [2, 4])
def test_scores_are_those_of_the_plain_tree(spark, monkeypatch, depth):
    monkeypatch.setattr(suffix_model, "RANGE", 300)
    monkeypatch.setattr(suffix_model, "CHUNK", 500)
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice(["the cat sat", "a dog", "big Dog ran off", "one bird", f"w{rnd.randrange(90)}"]) for _ in range(rnd.randint(0, 30)))) for k in range(150)]
    rows += [(900, None), (901, "never seen words")]
    want = plain_scores(rows, depth)
    got = {r["doc_id"]: r["score"] for r in suffix_model.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), depth=depth).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_run_seen_twice_counts_at_any_size(spark):
    rnd = random.Random(9)
    pair = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2][:2]
    rows = [(k, " ".join(f"w{rnd.randrange(60_000)}" for _ in range(15_000))) for k in range(120)] + [(k, "zig zag zog") for k in pair]
    rows = [(1000 + n, t) for n, (_, t) in enumerate(rows[:120])] + rows[120:]
    out = {r["doc_id"]: r for r in suffix_model.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[pair[0]]["train_tokens"] > 1_000_000 and out[pair[0]]["score"] > out[pair[0]]["base_score"] + 8


def test_runs_move_in_turns(spark, tmp_path, monkeypatch):
    """Turns share out all runs; no turn holds most of them; counts and the tables between them are deleted; nulls, repeated and empty rows too."""
    rnd = random.Random(3)
    rows = [(k, " ".join(f"w{int(rnd.paretovariate(1))}" for _ in range(40))) for k in range(60)] + [(None, "w1 w2"), (5, None), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "false held_out")
    texts = suffix_model.chunks(docs)
    own = lambda now, turns: {(r["level"], r["runs"][8 * k : 8 * k + 8]) for r in suffix_model.packed(texts, 2, 1, False, now, turns).collect() for k in range(len(r["runs"]) // 8)}
    whole, shares = own(0, 1), [own(k, 3) for k in range(3)]
    assert set.union(*shares) == whole and sum(map(len, shares)) == len(whole) and max(map(len, shares)) < 0.5 * len(whole)
    seen = []
    monkeypatch.setattr(suffix_model.common, "materialize", lambda df: seen.append(plain(df)) or seen[-1])
    got = suffix_model.report(docs.drop("held_out")).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1
    gone = [t for t in seen if {"context", "n"} <= set(t.columns)]
    assert len(gone) > suffix_model.TURNS and not any(Path(urlparse(f).path).exists() for t in gone for f in t.inputFiles())


plain = suffix_model.common.materialize
