"""Fingerprints and toxicity against plain versions of their definitions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from vigilspark.llm import fingerprint, toxicity

MASK = (1 << 64) - 1


def mixed(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * factor) & MASK
    return x ^ (x >> 33)


def gram_hash(gram, short):
    h = 0
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & MASK
        h ^= h >> 29
    return mixed((h + short) & MASK)


def order_minhash(text, k, size, sketches):
    """Of each hash function the `size` least of all (gram, occurrence) items, in the order of the text."""
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] or [text]
    seen, items = Counter(), []
    for g in grams:
        items.append(mixed(gram_hash(g, len(text) < k) ^ (seen[g] * 0xD6E8FEB86659FD93 & MASK)))
        seen[g] += 1
    out = []
    for factor, mask in zip(*(x.tolist() for x in fingerprint.constants(sketches)), strict=True):
        least = sorted(range(len(items)), key=lambda i: (((items[i] & 0xFFFFFFFF ^ mask) * factor) & 0xFFFFFFFF, i))[:size]
        value = 0
        for n in range(size):
            x = items[sorted(least)[n]] if n < len(least) else None
            swapped = 0 if x is None else ((x & 0xFFFFFFFF) << 32) | (x >> 32)
            value = mixed((value * 31 & MASK) ^ swapped)
        out.append(value & 0xFFFFFFFF)
    return out


def test_sketches_are_those_of_all_items():
    rnd, (factors, masks) = random.Random(4), fingerprint.constants()
    texts = ["", "a", "abcde", "abcdef", "aaaaaaaaaaaa", "\U0001f600é" * 9, "ab" * 40, "".join(rnd.choice("ab ") for _ in range(fingerprint.BLOCK + 900))]
    texts += ["".join(rnd.choice("abc é中") for _ in range(rnd.randint(1, 300))) for _ in range(40)]
    for t in texts:
        for size in (2, 3):
            assert fingerprint.sketch(t, factors, masks, 6, size).tolist() == order_minhash(t, 6, size, fingerprint.SKETCHES), t[:40]


def test_report_is_that_of_all_rows_in_order(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(-4, 30)]), rnd.choice([None, "", "same text here"] + ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 120))) for _ in range(6)])) for _ in range(70)]
    got = fingerprint.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    finger = lambda t: order_minhash(t, fingerprint.K, fingerprint.TUPLE, fingerprint.SKETCHES)
    hexed = lambda f: b"".join(x.to_bytes(4, "little") for x in f).hex()
    share = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    want = []
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        f, g = finger(t), finger(changed)
        want.append((str(i), len(t), hashlib.sha256(changed.encode()).hexdigest(), hexed(f), hexed(g), share(f, g), share(f, finger(following))))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def all_segments(scores):
    """The best of all segments, then those left and right of it."""
    best = max(((sum(scores[a : b + 1]), a, b) for a in range(len(scores)) for b in range(a, len(scores))), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    s, a, b = best
    return [(x, i, j) for x, i, j in all_segments(scores[:a])] + [best] + [(x, i + b + 1, j + b + 1) for x, i, j in all_segments(scores[b + 1 :])]


def test_segments_are_those_of_all_places():
    rnd = random.Random(6)
    for _ in range(150):
        names = [f"{c}{d}" for c in "abcde" for d in "xyz"]
        model = toxicity.Model({w: rnd.uniform(-3, 3) for w in names[:10]}, gap=rnd.choice([0.05, 0.7]))
        words = [rnd.choice(names) for _ in range(rnd.randint(0, 30))]
        text = " ".join(words)
        found, n = model.segments(text)
        want = all_segments([model.weights.get(w, -model.gap) for w in words])
        ends = [len(" ".join(words[:k])) for k in range(len(words) + 1)]
        assert n == len(words) and [f[1:] for f in found] == [(ends[a] + (a > 0), ends[b + 1]) for _, a, b in want]
        assert [f[0] for f in found] == pytest.approx([s for s, _, _ in want])


def test_weights_and_curve_are_those_of_all_labelled_texts(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(600):
        toxic = int(rnd.random() < 0.3)
        w = [rnd.choice(["red", "green", "blue", "sea", "hill", "road", "tree"]) for _ in range(rnd.randint(3, 12))]
        w += ["grim", "foul"][: rnd.randint(0, 2)] if toxic or rnd.random() < 0.05 else ["kind"] * (rnd.random() < 0.4)
        rows.append((k, " ".join(w) + f" u{'abcdefghij'[k % 10]}{'klmnop'[k % 6]}", toxic))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    learnt: dict[str, int] = {}
    for k, t, y in rows:  # of equal texts that of the smallest id
        if zlib.crc32(str(k).encode()) % 4 != 2:
            learnt.setdefault(t, y)
    counts = {y: Counter(w for t, z in learnt.items() if z == y for w in set(t.split())) for y in (0, 1)}
    clean, toxic, prior, z = sum(counts[0].values()), sum(counts[1].values()), 1000.0, 5.0
    want, share = {}, {}
    for w in counts[0].keys() | counts[1].keys():
        c, t = counts[0][w], counts[1][w]
        e1, e0 = (c + t) * toxic / (clean + toxic), (c + t) * clean / (clean + toxic)
        if 2 * ((t * math.log(t / e1) if t else 0) + (c * math.log(c / e0) if c else 0)) >= z * z:
            a = prior * (c + t) / (clean + toxic)
            want[w] = math.log((t + a) / (toxic + prior - t - a)) - math.log((c + a) / (clean + prior - c - a))
            share[w] = (c + a) / (clean + prior)
    assert {"grim", "foul"} <= want.keys() and model.weights == pytest.approx(want)
    # the decay makes the clean word model's mean exactly one
    assert sum(p * math.exp(model.decay * want[w]) for w, p in share.items()) + (1 - sum(share.values())) * math.exp(-model.decay * model.gap) == pytest.approx(1.0, abs=1e-6)
    # the curve is the best one: no slope is left in the penalised likelihood of the bins
    bins = Counter()
    for t, y in learnt.items():
        scores = [s for s, _, _ in all_segments([want.get(w, -model.gap) for w in t.split()])]
        bins[round(statistic(model, scores, len(t.split())) / toxicity.BIN) * toxicity.BIN, y] += 1
    p = {x: 1 / (1 + math.exp(-model.slope * x - model.shift)) for x, _ in bins}
    assert sum(n * (y - p[x]) for (x, y), n in bins.items()) == pytest.approx(0, abs=1e-3)
    assert sum(n * (y - p[x]) * x for (x, y), n in bins.items()) - 1e-3 * model.slope == pytest.approx(0, abs=1e-3)
    got = {r["doc_id"]: r["score"] for r in toxicity.report(docs, labels).collect()}
    for k, t, _ in rows:
        scores = [s for s, _, _ in all_segments([want.get(w, -model.gap) for w in t.split()])]
        assert got[k] == pytest.approx(1 / (1 + math.exp(-model.slope * statistic(model, scores, len(t.split())) - model.shift)))


def statistic(model, scores, n):
    """The best over r of the r highest segments' sum statistic, never below the floor."""
    best, scores = [toxicity.FLOOR], sorted(scores, reverse=True)
    for r in range(1, len(scores) + 1):
        best.append(model.decay * sum(scores[:r]) - r * math.log(max(n, 1) + 1) + math.log(math.factorial(r)))
    return max(best)
