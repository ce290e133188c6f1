"""Language identification by Bayesian evidence fusion.

Evidence on a text's language: letter trigrams of its words (naive Bayes per word), the language that its markup declares, the
suffix or language directory of its address, and where it comes from. The prior of a host is smoothed hierarchically:
the counts of all hosts smooth a suffix's, and these a host's; the counts are those of the text evidence alone, over all
rows, by one grouped aggregation. Every host has a prior of its own, however few its rows; priors are a table, joined by host. Declarations count by how often they agree with the text, by the same aggregation.

The trigram model is fitted on a bounded sample: of every language about `sample` rows, or all where
it has fewer, by a hash of the id. Texts are scored whole. Text that looks like no language (no letters, or letter sequences
that even uniform letters explain better) is `und`.

Null texts count as empty; without letters, the language is `und` and the score 0. Null hosts form one host. Repeated rows are
scored each. Without any row to fit on, all is `und`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
MAX_WORDS = 200_000  # remembered by a Python worker; results don't depend on it
LETTERS = 60  # letters of a uniform writer
TEMPER = 0.5  # trigrams overlap, so their evidence counts half
STRENGTH = 20.0  # rows that a parent's prior is worth
SMALL, COMMON = 2_000_000, 1000  # numbers of a table of priors that is sent to every task; a host with this part of all rows is frequent
TOP = 1000.0  # evidence beyond this many nats changes nothing


@dataclass
class Model:
    names: list[str]
    grams: dict[str, np.ndarray]  # trigram -> log probability of its last letter after the others, by language
    starts: dict[str, np.ndarray]  # two letters -> the same for letters not seen after them

    def word(self, w: str) -> np.ndarray:
        """Log-likelihood of a word by language, and by uniform letters in the last place."""
        w = f" {w} "
        out = np.zeros(len(self.names) + 1)
        for k in range(len(w) - 2):
            g = self.grams.get(w[k : k + 3])
            out[:-1] += self.starts.get(w[k : k + 2], -math.log(LETTERS)) if g is None else g
        out[-1] = -(len(w) - 2) * math.log(LETTERS)
        return out


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[k : k + 3] for k in range(len(w) - 2)]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = 20_000) -> Model:
    common.ship(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    names = sorted(r["lang"] for r in sizes)
    full = 1 << 30
    most = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(full, full * sample // r["n"]))]) if sizes else None
    few = known.where(F.pmod("h", F.lit(full)) < (F.lit(0) if most is None else F.element_at(most, F.col("lang")))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang_, text_ in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                own = seen.setdefault(lang_, Counter())
                for w, n in Counter(WORD.findall(text_.lower())).items():
                    for g in grams(w):
                        own[g] += n
        rows = [(a, g, n) for a, c in seen.items() for g, n in c.items()]
        yield pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "gram": [r[1] for r in rows], "n": [r[2] for r in rows]}, schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))

    found = few.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1").collect()  # bounded by the sample
    at = {a: k for k, a in enumerate(names)}
    table: dict[str, np.ndarray] = {}
    for r in found:
        table.setdefault(r["gram"], np.zeros(len(names)))[at[r["lang"]]] = r["n"]
    starts: dict[str, np.ndarray] = {}
    for g, n in table.items():
        starts[g[:2]] = starts.get(g[:2], 0) + n
    return Model(names, {g: np.log((n + 0.5) / (starts[g[:2]] + 0.5 * LETTERS)) for g, n in table.items()}, {s: np.log(0.5 / (n + 0.5 * LETTERS)) for s, n in starts.items()})


def likelihoods(text: Column, model: Model) -> Column:
    """array<double>: log-likelihood of the whole text by language, uniform letters last, less the greatest; null without letters."""

    @F.pandas_udf("array<double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at: dict[str, int] = {}
        table = np.zeros((1024, len(model.names) + 1))
        for s in texts:
            out = []
            for t in s:
                words = WORD.findall(t.lower())
                if not words:
                    out.append(None)
                    continue
                if len(at) > MAX_WORDS:
                    at.clear()
                for w in set(words).difference(at):
                    if len(at) == len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    table[len(at)] = model.word(w)
                    at[w] = len(at)
                own = table[np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
                own[:-1] *= TEMPER
                own[-1] *= TEMPER
                out.append(np.maximum(own - own.max(), -TOP))
            yield pd.Series(out, dtype=object)

    return run(text)


def suffix(host: Column) -> Column:
    return F.coalesce(F.substring_index(host, ".", -1), F.lit(""))


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag, whole: fil of fil-PH, pt of pt_BR; null without one of two to eight letters."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(tag)), "^([a-z]{2,8})(?![a-z])", 1), F.lit(""))


def host_of(url: Column) -> Column:
    """The host of an address in small letters, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(common.whole(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#@]+)", 1))


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """Adds `_ll`, `_text` (the language by text alone, null if none), `_said` and `_host`. rows: text, host, declared."""
    df = rows.withColumn("_ll", likelihoods(common.whole(F.col("text")), model))
    best = F.array_position(F.col("_ll"), F.array_max("_ll"))
    name = F.element_at(F.lit([*model.names, "und"]), best.cast("int"))
    return df.withColumn("_text", F.when(F.col("_ll").isNotNull(), F.nullif(name, F.lit("und")))).withColumn("_said", primary(F.col("declared"))).withColumn("_host", F.coalesce(F.col("host"), F.lit("")))


@dataclass
class Priors:
    hosts: DataFrame  # `_host`, `_n` (its rows), `_prior`: log priors by language, of every host
    agree: float


def priors(seen: DataFrame, model: Model) -> Priors:
    """Log priors by host, smoothed by its suffix's and by the overall ones. seen: `_host`, `_said` and `_text` of all rows."""
    n = range(len(model.names))
    counts = [F.count_if(F.col("_text") == a).alias(f"c{k}") for k, a in enumerate(model.names)]
    whole = seen.agg(F.count_if(F.col("_said") == F.col("_text")).alias("same"), F.count_if(F.col("_said").isin(model.names) & F.col("_text").isNotNull()).alias("said"), *counts).first()
    total = sum(whole[f"c{k}"] for k in n)
    top = F.array(*[F.lit((whole[f"c{k}"] + 1) / (total + len(n))) for k in n]).cast("array<double>")

    def smoothed(own: Column, parent: Column) -> Column:
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + STRENGTH
        return F.zip_with(own, parent, lambda x, q: (x + STRENGTH * q) / size)

    own = F.array(*[F.col(f"c{k}").cast("double") for k in n]).cast("array<double>")
    hosts = seen.groupBy("_host").agg(F.count("*").alias("_n"), *counts).withColumn("_suffix", suffix(F.col("_host")))
    hosts = common.materialize(hosts)
    suffixes = hosts.groupBy("_suffix").agg(*([F.sum(f"c{k}").alias(f"c{k}") for k in n] or [F.count("*")])).select("_suffix", smoothed(own, top).alias("_parent"))
    found = hosts.join(suffixes, "_suffix").select("_host", "_n", F.transform(smoothed(own, F.col("_parent")), lambda x: F.log(x)).alias("_prior"))
    return Priors(common.materialize(found), (whole["same"] + 1.0) / (whole["said"] + 2.0))


def with_priors(df: DataFrame, p: Priors, languages: int) -> DataFrame:
    """df with `_prior`. Rows may carry texts: they stay where they are while the table has SMALL numbers at most; beyond, so do those of hosts with a thousandth of all rows (a thousand hosts at most), and no such host is a single task."""
    hosts = p.hosts.select("_host", "_prior")
    if p.hosts.count() * languages <= SMALL:
        return df.join(F.broadcast(hosts), "_host")
    rows = p.hosts.agg(F.sum("_n")).first()[0]
    often = F.broadcast(p.hosts.where(F.col("_n") * COMMON >= rows).select("_host", "_prior"))
    rest = df.join(often.select("_host"), "_host", "left_anti").join(p.hosts.where(F.col("_n") * COMMON < rows).select("_host", "_prior"), "_host")
    return df.join(often, "_host").unionByName(rest)


def fuse(df: DataFrame, model: Model, p: Priors) -> DataFrame:
    """Adds lang_found, lang_score (its posterior) and drops the columns of evidence. Uniform letters have a prior of a hundredth. p: of all hosts of df."""
    if not model.names:
        out = df.withColumn("lang_found", F.lit("und")).withColumn("lang_score", F.lit(0.0))
        return out.drop("_ll", "_text", "_said", "_host")
    names = model.names
    df = with_priors(df, p, len(names))
    other = math.log((1 - p.agree) / max(1, len(names) - 1) + 1e-6)
    parts = []
    for k, a in enumerate(names):
        said = F.when(F.col("_said").isin(names), F.when(F.col("_said") == a, math.log(p.agree)).otherwise(other)).otherwise(0.0)
        parts.append(F.col("_ll")[k] + F.col("_prior")[k] + said)
    parts.append(F.col("_ll")[len(names)] + math.log(0.01))
    df = df.withColumn("_sum", F.array(*parts)).withColumn("_top", F.array_max("_sum"))
    found = F.element_at(F.lit([*names, "und"]), F.array_position("_sum", F.col("_top")).cast("int"))
    mass = F.aggregate("_sum", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    return df.withColumn("lang_found", F.when(F.col("_ll").isNull(), "und").otherwise(found)).withColumn("lang_score", F.when(F.col("_ll").isNull(), 0.0).otherwise(1 / mass)).drop("_ll", "_text", "_said", "_host", "_prior", "_sum", "_top")


#: The language tag of an html element.
MARKUP = r"(?i)<html[^>]*\blang=[\"']?([a-z]{2,8}(?![a-z])[a-z0-9_-]*)"


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as rows of evidence: the source is the host; markup inside the text may declare a language."""
    text = common.whole(F.col("text"))
    said = F.when(F.lower(text).contains("<html"), F.regexp_extract(text, MARKUP, 1))
    return docs.withColumns({"host": F.col("source"), "declared": F.nullif(said, F.lit(""))})


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages as rows of evidence: text without tags, the host, and the language that markup or else the address declares."""
    html = common.whole(F.col("html"))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    markup = F.nullif(F.regexp_extract(html, MARKUP, 1), F.lit(""))
    path = F.nullif(F.regexp_extract(common.whole(F.col("url")), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2,3}(?:[-_][a-z0-9]{2,4})?)/", 1), F.lit(""))
    host = host_of(F.col("url"))
    return pages.select("page_id", text.alias("text"), F.nullif(host, F.lit("")).alias("host"), F.coalesce(markup, path).alias("declared"))


def identify(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """keys, lang_found, lang_score, text_lang of every row; texts are read once, then only their evidence moves."""
    seen = common.materialize(evidence(rows, model).select(*keys, "_ll", "_text", "_said", "_host"))
    return fuse(seen.withColumn("text_lang", F.coalesce(F.col("_text"), F.lit("und"))), model, priors(seen, model))


def report(docs: DataFrame, pages: DataFrame) -> DataFrame:
    model = fit(docs)
    cols = ["kind", "doc_id", "page_id", "text", "host", "declared"]
    a = from_documents(docs).select(F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("long").alias("page_id"), "text", "host", "declared")
    b = from_pages(pages).select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "host", "declared")
    return identify(a.unionByName(b).select(*cols), model, ["kind", "doc_id", "page_id"])


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents in some language, all columns as they were. Texts are scored once: their evidence is written beside them, and read again without them for the priors."""
    model = fit(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    seen = common.materialize(evidence(from_documents(docs.select(row, "text", "source")), model).select("_row", "_ll", "_text", "_said", "_host"))
    scored = fuse(seen, model, priors(seen, model))
    return scored.where((F.col("lang_found") != "und") & (F.col("lang_score") >= least)).select("_row.*")
