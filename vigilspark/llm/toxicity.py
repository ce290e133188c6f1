"""Toxicity by maximum-scoring segments.

Word weights are log-odds of toxic against clean labelled texts under an informative Dirichlet prior (each word's share
of all words, worth `prior` words in total), of words counted once for each text; a weight counts only where its likelihood ratio is worth `z` standard
deviations, any other word costs `gap`. A linear scan finds every maximal-scoring segment of a text (toxic passages). Under the clean
word model such scores follow an extreme-value law: `decay` solves E[exp(decay * weight)] = 1, so that a segment's
expected number in n words is about n * exp(-decay * score); several segments combine by the sum statistic. A logistic
curve fitted on labelled rows, by bins, turns the statistic into a probability.

The classifier is fitted on a bounded sample: about `sample` labelled rows, by a hash of the id. All texts are scored
whole, in one pass without a shuffle.

Null and empty texts get the score of texts without any evidence. Rows without a usable label are not learnt from;
of repeated labels of an id the highest counts. Repeated rows are scored each. Without labelled rows of both kinds every
score is the share of toxic ones (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
FLOOR = -12.0  # statistic of a text without evidence
BIN = 0.25


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    gap: float = 0.05
    decay: float = 1.0
    slope: float = 0.0
    shift: float = -20.0

    def segments(self, text: str) -> tuple[list[tuple[float, int, int]], int]:
        """Maximal-scoring segments as (score, first, last character place), and the number of words. One scan; each event is a weighted word with the cost of the gap before it."""
        words = WORD.findall(text.lower())
        if self.weights.keys().isdisjoint(words):
            return [], len(words)
        total, before, open_ = 0.0, -1, []  # open_: [left total, right total, first word, last word]
        for k, w in enumerate(words):
            s = self.weights.get(w)
            if s is None:
                continue
            total -= self.gap * (k - before - 1)
            before = k
            if s <= 0:
                total += s
                continue
            own = [total, total + s, k, k]
            total += s
            while True:
                j = next((j for j in range(len(open_) - 1, -1, -1) if open_[j][0] < own[0]), -1)
                if j < 0 or open_[j][1] >= own[1]:
                    open_.append(own)
                    break
                own = [open_[j][0], own[1], open_[j][2], own[3]]
                del open_[j:]
        places = [m.span() for m in WORD.finditer(text.lower())]
        return [(r - left, places[a][0], places[b][1]) for left, r, a, b in open_], len(words)

    def statistic(self, scores: list[float], n: int) -> float:
        """The best sum statistic over the r highest segments, r = 1, 2, ..."""
        best, total, size = FLOOR, 0.0, math.log(max(n, 1) + 1)
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            total += self.decay * s - size
            best = max(best, total + math.lgamma(r + 1))
        return max(best, FLOOR)

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.shift))))


def deviation(c: int, t: int, share: float) -> float:
    """Root of the likelihood-ratio statistic of t toxic and c clean uses, where the share of toxic ones is expected."""
    n = c + t
    part = lambda k, e: k * math.log(k / e) if k else 0.0
    return math.sqrt(max(0.0, 2 * (part(t, n * share) + part(c, n * (1 - share)))))


def weigh(counts: list[tuple[str, int, int]], prior: float, z: float, gap: float) -> Model:
    """Weights from (word, clean texts, toxic texts)."""
    clean, toxic = sum(c for _, c, _ in counts), sum(t for _, _, t in counts)
    if not clean or not toxic:
        return Model(gap=gap)
    weights, share = {}, {}
    for w, c, t in counts:
        if w is None:  # all other words
            continue
        a = prior * (c + t) / (clean + toxic)
        odds = math.log((t + a) / (toxic + prior - t - a)) - math.log((c + a) / (clean + prior - c - a))
        if deviation(c, t, toxic / (clean + toxic)) >= z:
            weights[w], share[w] = odds, (c + a) / (clean + prior)
    rest = 1 - sum(share.values())
    moment = lambda x: sum(p * math.exp(min(600.0, x * weights[w])) for w, p in share.items()) + rest * math.exp(-gap * x) - 1
    low, high = 1e-6, 1.0
    if any(v > 0 for v in weights.values()):
        while moment(high) < 0 and high < 100:
            high *= 2
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if moment(mid) < 0 else (low, mid)
    return Model(weights, gap, high)


def calibrate(model: Model, bins: list[tuple[float, int, int]]) -> Model:
    """A logistic curve through (statistic, clean, toxic) counts, by Newton's steps with a small ridge."""
    n, t = sum(c + t for _, c, t in bins), sum(t for _, _, t in bins)
    if not n or not t or t == n:
        model.slope, model.shift = 0.0, (30.0 if n and t == n else -30.0)
        return model
    a, b = 0.0, math.log(t / (n - t))
    for _ in range(60):
        g0 = g1 = 0.0
        h00 = h11 = 1e-3
        h01 = 0.0
        for x, c, k in bins:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            d, w = k - (c + k) * p, (c + k) * p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + d, g1 + d * x, h00 + w, h01 + w * x, h11 + w * x * x
        g1 -= 1e-3 * a
        det = h00 * h11 - h01 * h01
        step_b, step_a = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        size = max(1.0, abs(step_a), abs(step_b) / 3)
        a, b = a + step_a / size, b + step_b / size
        if abs(step_a) + abs(step_b) < 1e-9:
            break
    model.slope, model.shift = max(a, 0.0), b
    return model


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of about `sample` labelled rows outside the held-out fold; the ids are few by that bound, so they are broadcast."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (common.fold(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, usable.count()))
    few = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", common.whole(F.col("text")).alias("text"))
    # of copies of a text one is learnt from: many copies are no more evidence than one
    first = texts.join(F.broadcast(few), "doc_id").groupBy(F.xxhash64("text"), F.length("text")).agg(F.min(F.struct("doc_id", "toxic")).alias("f")).select("f.*")
    return texts.join(F.broadcast(common.materialize(first)), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 60_000, prior: float = 1000.0, z: float = 5.0, gap: float = 0.05) -> Model:
    common.ship(docs.sparkSession)
    rows = labelled(docs, labels, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                seen[toxic].update(set(WORD.findall(text.lower())))
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"word": words, "clean": [seen[0][w] for w in words], "toxic": [seen[1][w] for w in words]}, schema=pa.schema([("word", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    counts = rows.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = common.materialize(counts)
    total = counts.agg(F.coalesce(F.sum("clean"), F.lit(0)).alias("c"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    # words that can't be significant take no part, but in the totals
    c, t, share = F.col("clean"), F.col("toxic"), total["t"] / max(1, total["c"] + total["t"])
    part = lambda k, p: F.when(k > 0, k * F.log(k / ((c + t) * p))).otherwise(0.0)
    strong = counts.where(2 * (part(t, F.lit(share)) + part(c, F.lit(1 - share))) >= z * z)
    kept = [(r["word"], r["clean"], r["toxic"]) for r in strong.collect()]  # bounded by the sample
    rest = (None, total["c"] - sum(k[1] for k in kept), total["t"] - sum(k[2] for k in kept))
    model = weigh([*kept, rest], prior, z, gap)
    stats = rows.select("toxic", F.round(evidence(F.col("text"), model)["x"] / BIN).alias("bin")).groupBy("bin").agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("t"))
    return calibrate(model, [(r["bin"] * BIN, r["c"], r["t"]) for r in stats.collect()])  # a few hundred bins


def evidence(text: Column, model: Model) -> Column:
    """struct(x, score, passages): the statistic, its probability, and significant passages as start:end of characters."""

    @F.pandas_udf("x double, score double, n_passages int, passages string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            rows = []
            for text in s:
                found, n = model.segments(text)
                x = model.statistic([f[0] for f in found], n)
                good = [f for f in found if model.decay * f[0] > math.log(n + 1)]
                rows.append((x, model.score(x), len(good), ",".join(f"{a}:{b}" for _, a, b in good)))
            yield pd.DataFrame(rows, columns=["x", "score", "n_passages", "passages"]).astype({"passages": object})

    return run(text)


def score(docs: DataFrame, model: Model, name: str = "tox") -> DataFrame:
    """docs with a struct column of the evidence."""
    return docs.withColumn(name, evidence(common.whole(F.col("text")), model))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("tox.score").alias("score"),
        (F.col("tox.score") >= threshold).cast("int").alias("predicted"),
        F.col("tox.n_passages").alias("n_passages"),
        F.col("tox.passages").alias("passages"),
    )
