r"""Periodic runs: stretches of words that repeat with a period four times or more, found by tiles of all scales.

A document's words are numbered; equal words have equal numbers. For each octave of periods P <= p < 2P the document is
cut into overlapping tiles: one at each boundary b, a multiple of 2P, from b - 4P to b + 2P. A run of four periods or more holds a
boundary b for which word b - p equals word b, and so begins a stretch of agreement (words p apart are equal) on
either side. How far it goes is the Z-function of the tile's halves: of the words from b on against those before it
(to the right), and of the reversed words before b against themselves (to the left). A tile solves its boundary for all its
periods at once, knows nothing of other tiles, and sees at most 2P words of agreement on either side. Its fragments, by
(document, period), are shuffled and stitched where they meet; a run's smallest period is the least that gives the same stretch.

A tile in which no period agrees at a few words around its boundary has no fragment: this is checked for all tiles of an octave
at once before their Z-functions are computed. Documents of more than `span` words have their tiles dealt to other tasks,
octave by octave, in ranges of tiles with the words these need; all others solve them where they are read.
Only documents with fragments are shuffled and read again to leave out their repeated words.

Null text: no words. A null id asks for no repetition; equal ids and repeated rows are documents of their own. An
empty table gives no rows. Texts are read whole; a document's words are one list in a task. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, TIMES = 6, 4  # a run has LEAST words and TIMES periods at least
SPAN = 1 << 17
LOOK = 8  # words looked at before a tile is solved


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with the repetition that the id asks for: from word a on, the p words from there again and again."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * ((n - a) // p + 1))[: n - a]


def numbered(words: list[str]) -> np.ndarray:
    """Equal words have equal numbers."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int32, count=len(words))


def octaves(n: int) -> Iterator[int]:
    """The least period of each octave in which n words can have a run."""
    p = 1
    while TIMES * p <= n:
        yield p
        p *= 2


def z_function(s: list[int]) -> list[int]:
    """For each place of s, how many words from there on are those that s begins with."""
    n = len(s)
    z = [0] * n
    low = high = 0
    for i in range(1, n):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def solve(words: np.ndarray, b: int, least: int) -> list[tuple[int, int, int]]:
    """The tile of a boundary: (period, first, end) of the agreement around it, for periods of the octave `least`. Places are those of `words`, which may be a part of a document."""
    low, high = max(0, b - 4 * least), min(len(words), b + 2 * least)
    head, tail = words[low:b].tolist(), words[b:high].tolist()
    back, ahead = head[::-1], len(tail)
    # to the right: how far the words from b - p on go as those from b on
    right = z_function(tail + [-1] + head + tail)
    # to the left: how far the words before b - p, backwards, go as those before b
    left = z_function(back)
    out = []
    for p in range(least, min(2 * least, b - low + 1)):
        r = min(right[ahead + 1 + len(head) - p], 2 * least, ahead)
        if r == 0:
            continue
        k = min(left[p] if p < len(left) else 0, 2 * least)
        full = max(LEAST, TIMES * p) - p
        # what neither reaches the tile's limits nor makes a run is none
        if r + k >= full or r == 2 * least or k == 2 * least:
            out.append((p, b - p - k, b - p + r))
    return out


def promising(words: np.ndarray, least: int, first: int, end: int) -> np.ndarray:
    """Boundaries from `first` up to `end` that may have a fragment: for some period, enough words around it agree."""
    n, step = len(words), 2 * least
    b = np.arange(-(-first // step) * step, end, step)
    found = []
    rows = max(1, (1 << 20) // least)
    need = min(LOOK, least + (least + 1) // 2)
    for k in range(0, len(b), rows):
        at = b[k : k + rows]
        back = at[:, None] - np.arange(least, 2 * least)[None, :]
        i, j = np.nonzero((back >= 0) & (words[np.maximum(back, 0)] == words[at][:, None]))
        p, x = j + least, at[i]
        # the agreement at a boundary has `need` words on one side at least, as its run has three periods of it
        right, left = np.ones(len(p), bool), np.ones(len(p), bool)
        for step_ in range(1, need):
            y = x + step_
            right &= (y < n) & (words[np.minimum(y, n - 1)] == words[np.minimum(y, n - 1) - p])
        for step_ in range(1, need + 1):
            y = x - step_ - p
            left &= (y >= 0) & (words[np.maximum(y, 0)] == words[np.maximum(y, 0) + p])
        found.append(np.unique(x[right | left]))
    return np.concatenate(found) if found else b


def fragments(words: np.ndarray, least: int, first: int, end: int, offset: int = 0) -> list[tuple[int, int, int]]:
    """Of the tiles of an octave with boundaries from `first` up to `end` the fragments (period, first, end), those that meet joined."""
    out = [f for b in promising(words, least, first, end) for f in solve(words, int(b), least)]
    return [(p, a + offset, e + offset) for p, a, e in joined(out)]


def joined(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of a period that overlap or touch as one."""
    out: list[tuple[int, int, int]] = []
    for p, a, e in sorted(found):
        if out and out[-1][0] == p and a <= out[-1][2]:
            out[-1] = (p, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((p, a, e))
    return out


def pieces(words: np.ndarray, span: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(octave, first boundary, offset, words) of ranges of tiles of a long document, about `span` words each or one tile."""
    n = len(words)
    for least in octaves(n):
        size = max(2 * least, span // (2 * least) * 2 * least)
        for first in range(0, n, size):
            low, high = max(0, first - 4 * least), min(n, first + size + 2 * least)
            yield least, first, low, words[low:high]


def digests(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """What a document returns, of its words and its runs (start, length, period)."""
    runs = sorted(runs)
    keep = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, p in runs:
        keep[start + p] += 1
        keep[start + length] -= 1
    kept = words if not runs else [w for w, drop in zip(words, np.cumsum(keep)[:-1].tolist(), strict=True) if not drop]
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    return len(runs), best[0], best[1], best[2], milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(kept))


RESULT = [("n_runs", "int64", "bigint"), ("start", "int64", "bigint"), ("length", "int64", "bigint"), ("period", "int64", "bigint"), ("exponent_milli", "int64", "bigint"), ("runs_sha256", "string", "string"), ("collapsed_sha256", "string", "string")]


def frames(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema(columns)
    return pa.RecordBatch.from_pydict({f.name: [r[k] for r in rows] for k, f in enumerate(schema)}, schema=schema)


def find(docs: DataFrame, text: str = "text", plant: bool = True, span: int = SPAN) -> DataFrame:
    """doc_id and the columns of RESULT. plant: whether words are first repeated as an id asks for."""
    spark = docs.sparkSession
    common.ship(spark)
    arrow = {"int64": pa.int64(), "string": pa.string()}
    result = [(n, arrow[a]) for n, a, _ in RESULT]
    fragment = pa.list_(pa.struct([("period", pa.int64()), ("first", pa.int64()), ("end", pa.int64())]))
    piece = pa.list_(pa.struct([("octave", pa.int64()), ("first", pa.int64()), ("stop", pa.int64()), ("offset", pa.int64()), ("words", pa.binary())]))
    columns = [("key", pa.int64()), ("doc_id", pa.int64()), ("done", pa.bool_()), *result, ("text", pa.string()), ("n", pa.int64()), ("fragments", fragment), ("pieces", piece)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for key, doc_id, text in common.rows_of(batch, "key", "doc_id", "text"):
                words = WORDS.findall(text)
                words = planted(words, doc_id) if plant else words
                ids = numbered(words)
                if len(ids) > span:
                    tiles = [{"octave": o, "first": a - low, "stop": min(a + max(2 * o, span // (2 * o) * 2 * o), len(ids)) - low, "offset": low, "words": w.tobytes()} for o, a, low, w in pieces(ids, span)]
                    out.append((key, doc_id, False, *[None] * len(RESULT), text, len(ids), [], tiles))
                else:
                    found = [f for o in octaves(len(ids)) for f in fragments(ids, o, 0, len(ids))]
                    if found:
                        out.append((key, doc_id, False, *[None] * len(RESULT), text, len(ids), [dict(zip(("period", "first", "end"), f, strict=True)) for f in found], []))
                    else:
                        out.append((key, doc_id, True, *digests(words, []), None, len(ids), [], []))
                held += len(text) if not out[-1][2] else 100
                if held > 4_000_000:
                    yield frames(columns, out)
                    out, held = [], 0
        yield frames(columns, out)

    types = ", ".join(f"{n} {t}" for n, _, t in RESULT)
    schema = f"key bigint, doc_id bigint, done boolean, {types}, text string, n bigint, fragments array<struct<period: bigint, first: bigint, end: bigint>>, pieces array<struct<octave: bigint, first: bigint, stop: bigint, offset: bigint, words: binary>>"
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), common.whole(F.col(text)).alias("text"))
    seen = common.materialize(keyed.mapInArrow(look, schema))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, octave, first, stop, offset, words in common.rows_of(batch, "key", "octave", "first", "stop", "offset", "words"):
                found = fragments(np.frombuffer(words, dtype=np.int32), octave, first, stop, offset)
                yield frames([("key", pa.int64()), ("period", pa.int64()), ("first", pa.int64()), ("end", pa.int64())], [(key, *f) for f in found])

    near = seen.select("key", F.explode("fragments").alias("f")).select("key", "f.*")
    dealt = seen.select("key", F.explode("pieces").alias("p")).select("key", "p.*").repartition("key", "octave", "offset")
    runs = stitched(near.unionByName(dealt.mapInArrow(tiles, "key bigint, period bigint, first bigint, end bigint")))
    rest = seen.where("not done").select("key", "doc_id", "text").join(runs, "key", "left")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, runs in common.rows_of(batch, "doc_id", "text", "runs"):
                words = WORDS.findall(text)
                words = planted(words, doc_id) if plant else words
                out.append((doc_id, *digests(words, [(r["start"], r["length"], r["period"]) for r in runs or []])))
            yield frames([("doc_id", pa.int64()), *result], out)

    whole = rest.select("doc_id", "text", "runs").mapInArrow(collapse, f"doc_id bigint, {types}")
    return seen.where("done").select("doc_id", *[n for n, _, _ in RESULT]).unionByName(whole)


def stitched(found: DataFrame) -> DataFrame:
    """key, runs array<struct<start, length, period>>: fragments (key, period, first, end) joined where they meet, long enough, each with its smallest period."""
    order = Window.partitionBy("key", "period").orderBy("first", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("new", F.when(reach.isNull() | (F.col("first") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    whole = parts.groupBy("key", "period", "island").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    long = whole.withColumn("length", F.col("end") - F.col("start") + F.col("period")).where((F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period")))
    smallest = long.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    return smallest.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))


def report(docs: DataFrame) -> DataFrame:
    return find(docs.select("doc_id", "text"))
