"""Periodic runs against every period tried at every word."""

import hashlib
import random
import re
import zlib

import numpy as np

from vigilspark.llm import periodic_runs as pr


def plain_runs(words):
    """All maximal stretches of a period, each with its smallest period."""
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                out.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, length, p) for (s, length), p in out.items())


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *row, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def texts(rnd, count):
    out = [None, "", " \n", "a a a a a", "a a a a a a", "ab ab ab ab ab", "a b a b a b a b", "a b a b a b a", "x\x0by\x0cx y\tx y\rx y", "é é é é"]
    for _ in range(count):
        words = []
        while len(words) < rnd.randint(1, 120):
            piece = [rnd.choice("abc") if rnd.random() < 0.6 else f"w{rnd.randint(0, 999)}" for _ in range(rnd.randint(1, 17))]
            words += piece * rnd.choice([1, 1, 2, 3, 4, 5, 9])
        out.append(" ".join(words))
    return out


def test_fragments_against_every_period():
    rnd = random.Random(1)
    for t in texts(rnd, 1500)[10:]:
        words = t.split()
        ids = pr.numbered(words)
        found = pr.joined([f for o in pr.octaves(len(ids)) for f in pr.fragments(ids, o, 0, len(ids))])
        long = {}
        for p, a, e in sorted(found):
            if e - a + p >= max(6, 4 * p):
                long.setdefault((a, e - a + p), p)
        assert sorted((s, n, p) for (s, n), p in long.items()) == plain_runs(words)


def test_z_function():
    rnd = random.Random(2)
    for _ in range(300):
        s = [rnd.randint(0, 1) for _ in range(rnd.randint(1, 30))]
        z = pr.z_function(s)
        for i in range(1, len(s)):
            k = 0
            while i + k < len(s) and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows(spark, all_texts, **more):
    df = spark.createDataFrame([(k, t, "x", 5) for k, t in enumerate(all_texts)], "doc_id long, text string, runs string, key int")
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in pr.find(df, **more).collect()}


def test_documents_against_plain(spark):
    all_texts = texts(random.Random(4), 250)
    got = rows(spark, all_texts)
    assert len(got) == len(all_texts)
    for k, t in enumerate(all_texts):
        assert got[k] == plain(k, t), t


def test_tiles_of_long_documents_are_dealt(spark):
    """With a small span every document is long."""
    all_texts = texts(random.Random(6), 40)
    got = rows(spark, all_texts, span=16)
    for k, t in enumerate(all_texts):
        assert got[k] == plain(k, t), t


def test_repeated_rows_null_ids_one_word_many_times(spark):
    df = spark.createDataFrame([(3, "a " * 500), (3, "a " * 500), (None, "b c " * 9), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["n_runs"], r["length"], r["period"]) for r in pr.report(df).collect()), key=str)
    assert got == sorted([(3, 1, 500, 1), (3, 1, 500, 1), (-1, 1, 18, 2), (-1, 0, None, None)], key=str)
    assert pr.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_text_is_one_run():
    ids = pr.numbered(("lorem ipsum dolor " * 20000).split())
    found = pr.fragments(ids, 2, 0, len(ids))
    assert found == [(3, 0, len(ids) - 3)] and isinstance(ids, np.ndarray)
