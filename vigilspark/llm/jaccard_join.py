"""Similarity join of word n-grams by Jaccard, with signature trees.

Documents with equal shingle sets are one set. Candidates come from an exact filter: sets of about one size class are cut into
parts by ranges of the shingle hash, one part more than two similar sets of the class can differ in shingles, so two
similar sets have an equal part. A part may be poor: empty, or all of its shingles frequent (in a share of HOT of all
documents; at most mean set size / HOT shingles, so they are broadcast). Spare parts make up for poor ones; only a set with more poor parts than
spare ones also offers these as keys. Both of two similar sets whose equal parts are all poor are such sets, so
the filter stays exact, while a passage that many documents share makes no candidates by itself. Sets that can be similar to larger ones offer keys in the next class too.
Each set is in the stars of its OWN least keys (its labels; sets with one label own its star, the least of them is the centre). The sets of any other key
go to the star that most of them own, and only those that don't own it make a row. So two similar sets share a star, nothing is
closed to chains before it is compared, and copies that meet in many keys, thus in many ranges of keys, make rows for their labels alone:
a pair of K keys with a share J of them in common makes about J * (1 - J)**OWN * K more, however many ranges there are.
All stars with one centre are one. A large star is dealt to parts, so that none is a single task:

0. Stars are pruned before texts move. A sketch of a set has a bit or two for each shingle; bits that differ are no more than shingles that differ, so
   a pair with too many isn't similar. A set stays in a star if its sketch may be like the centre's, or else like that of another set of the star.
1. Each set is compared with the centres of its stars. In groups of near copies this links almost all, to components.
2. Only stars whose sets are in several components go on. Sets outside the star's commonest component are compared with all sets of the star
   of about their own size, in tiles of bounded size. A tile builds two signature trees,
   whose nodes hold OR-combined bitmaps (one bit for each shingle of the tile that occurs twice, so overlaps are exact) and ranges of set
   sizes. Both are walked together; a pair of nodes is left when even the greatest possible overlap is too small, or
   when all below is linked already.

A task that meets a range of keys holds about 13 bytes for each key and set of the range. Of a key the lowest KEY bytes move, of a label four: keys of a range that
differ only above these, and labels that are equal by chance, make a candidate more, which the comparison drops.

Components of the links are those of all links. Nulls: a document without text or words has an empty set and links with
nothing; one without an id links with nothing and has no component id. Equal rows, also of one id, count once each in the
result. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .fingerprint import mix

WORDS, PERCENT = 4, 85
RATIO = 1.5  # of the sizes of a class
FLUSH = 400_000  # keys that a task sorts before it hands them on (about 30 MB with their copies); results don't depend on it
COUNT = 1_000_000  # shingles that a task counts by itself
MAX_WORDS = 200_000  # word hashes that a Python worker remembers; results don't depend on it
RANGE = 8_000_000  # shingles of the documents for each range of keys (about 3,000,000 keys); results don't depend on it
TILE = 150_000  # shingles of one side of a tile
SKETCHES = 1_000_000  # shingles that the sketches of one side of a tile stand for
PART = 512  # sets of a part of a star
KEY = 5  # bytes of a key that move: of the keys of a range, a share of about their number / 2**40 meets another by chance
OWN = 3  # labels of a set; results don't depend on it
SALTS = 64
FAN = 16
HOT = 5e-4


class Shingler:
    """Sorted 64-bit hashes of the distinct shingles of a text."""

    def __init__(self, size: int = WORDS):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        known, n = self.known, len(words)
        try:
            h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
        if not n:
            return h
        size = min(self.size, n)
        out = np.full(n - size + 1, size, dtype=np.uint64)
        for k in range(size):
            out = mix((out * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + len(out)])
        return np.unique(out)


def set_id(s: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def sketch(s: np.ndarray) -> bytes:
    """A bit for each shingle, of the least power of two (64 at least) that isn't below their number."""
    n = 64 << ((max(1, len(s)) - 1) // 64).bit_length()
    bits = np.zeros(n, dtype=bool)
    bits[(s & np.uint64(n - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they were with fewer bits."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] | sketches[:, half:]
    return sketches


def bits_that_differ(x: bytes, y: bytes) -> int:
    while len(x) != len(y):
        x, y = min(x, y, key=len), max(x, y, key=len)
        half = len(y) // 2
        y = (int.from_bytes(y[:half]) | int.from_bytes(y[half:])).to_bytes(half)
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def may_be_similar(x: list[bytes], n: np.ndarray, y: list[bytes], m: np.ndarray, percent: int) -> np.ndarray:
    """For each two sets (sketches and sizes) whether the bits that differ leave them similar; all similar sets are."""
    out = np.zeros((len(x), len(y)), dtype=bool)
    of_x, of_y = (np.array([len(b) // 8 for b in z]) for z in (x, y))
    for u in np.unique(of_x):
        for v in np.unique(of_y):
            at, to, words = np.flatnonzero(of_x == u), np.flatnonzero(of_y == v), int(min(u, v))
            if (100 * n[at].max() < percent * m[to].min()) or (100 * m[to].max() < percent * n[at].min()):
                continue
            a, b = (folded(np.frombuffer(b"".join(z[k] for k in own), dtype="<u8").reshape(len(own), -1), words) for z, own in ((x, at), (y, to)))
            step = max(1, (1 << 20) // len(to))
            for k in range(0, len(at), step):
                rows = at[k : k + step]
                differ = np.abs(n[rows][:, None] - m[to][None, :])
                bits = np.zeros(differ.shape, dtype=np.int64)
                for w in range(words):
                    bits += np.bitwise_count(a[k : k + step, None, w] ^ b[None, :, w])
                total = n[rows][:, None] + m[to][None, :]
                out[np.ix_(rows, to)] = (100 + percent) * (total - np.maximum(differ, bits)) >= 2 * percent * total
    return out


@cache
def classes(percent: int) -> list[tuple[int, int, int]]:
    """(largest size, parts, spare parts) of each size class."""
    out, top = [], 1
    while top < 1 << 40:
        differ = 2 * top * (100 - percent) // (100 + percent)  # shingles that only one of two similar sets can have
        parts, spare = differ + 1, 0
        if differ:
            least = max(1.0, top / RATIO * percent / 100)
            for _ in range(8):
                empty = parts * np.exp(-least / parts)
                spare = int(np.ceil(empty + 6 * np.sqrt(empty))) if empty > 1e-4 else 0
                parts = differ + 1 + spare
        out.append((top, parts, spare))
        top = max(top + 1, int(top * RATIO))
    return out


def keys(s: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    """The keys of a set: a hash for each part of its own class, and of the next if a similar set can be there. hot: sorted frequent shingles."""
    table = classes(percent)
    own = next(k for k, (top, _, _) in enumerate(table) if len(s) <= top)
    out, mixed = [], mix(s)
    rare = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] != s if len(hot) else np.ones(len(s), dtype=bool)
    for k in (own, own + 1):
        if k > own and len(s) * 100 < percent * (table[own][0] + 1):
            break
        _, parts, spare = table[k]
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        salt = np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        found = mix(np.add.reduceat(mixed, starts) ^ mix(part[starts] + salt))
        rich = np.add.reduceat(rare.astype(np.int64), starts) > 0
        if parts - int(rich.sum()) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[starts])
            out += [found, mix(mix(empty + salt) + np.uint64(1))]
        else:
            out.append(found[rich])
    return np.concatenate(out)


def own_labels(k: np.ndarray) -> np.ndarray:
    """The OWN least labels (four bytes) of a set's keys; the last one repeated if there are fewer."""
    least = np.unique(k.astype(np.uint32))[:OWN]
    return np.append(least, np.full(OWN - len(least), least[-1], dtype=np.uint32))


def stars(key: np.ndarray, at: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a set (its place in `labels`), a star's label and whether the set owns the star; at: the set of each key, places of equal sets being equal."""
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    key, at = key[new], at[new]
    own = (labels[at] == key.astype(np.uint32)[:, None]).any(axis=1)
    sets, stars_ = at[own], key[own].astype(np.uint32)  # a set alone too: tasks of other keys can't know whether others own the star
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]]))
    n = np.diff(np.append(first, len(key)))
    at = at[np.repeat(n > 1, n)]
    group = np.repeat(np.arange(int((n > 1).sum()), dtype=np.uint64), n[n > 1])
    # owners of each label in each key's sets; repeated labels of a set count once
    offered = labels[at]
    once = np.ones(offered.shape, dtype=bool)
    once[:, 1:] = offered[:, 1:] != offered[:, :-1]
    kinds, owners = np.unique(((group[:, None] << np.uint64(32)) | offered)[once], return_counts=True)
    best = np.lexsort((kinds, -owners, kinds >> np.uint64(32)))
    best = kinds[best][np.flatnonzero(np.concatenate([np.ones(min(1, len(best)), dtype=bool), np.diff(kinds[best] >> np.uint64(32)) > 0]))].astype(np.uint32)
    star = best[group.astype(np.int64)] if len(best) else best
    joins = ~(offered == star[:, None]).any(axis=1)
    return np.append(sets, at[joins]), np.append(stars_, star[joins]).astype(np.int64), np.arange(len(sets) + int(joins.sum())) < len(sets)


CHUNK = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("labels", pa.binary())])


def sliced(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Binary values: the bytes of the rows between each two cuts, without a copy."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def star_rows(docs: DataFrame, percent: int, size: int, ranges: int, hot) -> DataFrame:
    """(a, label, own): each set and the stars that it owns or that its keys lead to; a row may come from several ranges."""

    def emit(key: list[np.ndarray], sid: list[int]) -> pa.RecordBatch:
        k, ids, labels = np.concatenate(key or [np.zeros(0, np.uint64)]), np.array(sid, dtype=np.int64), np.array([own_labels(x) for x in key], dtype=np.uint32).reshape(-1, OWN)
        ids, first, at = np.unique(ids, return_index=True, return_inverse=True)
        labels, at = labels[first], np.repeat(at, [len(x) for x in key])
        bounds = (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges)
        where = np.searchsorted(bounds, k >> np.uint64(32), side="right")
        order = np.lexsort((k, at, where))  # an id stands once before all its keys of a range
        k, at, where = k[order], at[order], where[order]
        new = np.ones(len(k), dtype=bool)  # equal texts give equal rows
        new[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1])
        k, at, where = k[new], at[new], where[new]
        heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), dtype=bool), (at[1:] != at[:-1]) | (where[1:] != where[:-1])]))
        every = np.arange(ranges + 1)
        cut, head_cut = np.searchsorted(where, every), np.searchsorted(where[heads], every)
        counts = np.diff(np.append(heads, len(k))).astype(np.int32)
        short = np.ascontiguousarray(k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY])
        columns = [pa.array(every[:-1].astype(np.int32)), sliced(short, cut), sliced(ids[at[heads]], head_cut), sliced(counts, head_cut), sliced(labels[at[heads]], head_cut)]
        return pa.RecordBatch.from_arrays(columns, schema=CHUNK).filter(pa.array(cut[1:] > cut[:-1]))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, key, sid, total = Shingler(size), [], [], 0
        for batch in batches:
            for text in common.rows_of(batch, "text"):
                s = shingles(text)
                if not len(s):
                    continue
                key.append(keys(s, percent, hot.value))
                sid.append(set_id(s))
                total += len(key[-1])
                if total > FLUSH:
                    yield emit(key, sid)
                    key, sid, total = [], [], 0
        yield emit(key, sid)

    schema = pa.schema([("a", pa.int64()), ("label", pa.int64()), ("own", pa.bool_())])

    def meet(table: pa.Table) -> pa.Table:
        col = lambda name, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x in table[name].to_pylist()]])
        ids, counts, labels = col("ids", np.int64), col("counts", np.int32), col("labels", np.uint32).reshape(-1, OWN)
        ids, first, at = np.unique(ids, return_index=True, return_inverse=True)
        labels, at, short = labels[first], np.repeat(at.astype(np.int32), counts), col("keys", np.uint8).reshape(-1, KEY)
        slot, out = short[:, KEY - 1] >> 6, []  # a quarter of the keys at a time, since sorting takes several times their room
        for q in range(4):
            mine = np.flatnonzero(slot == q)
            key = np.zeros((len(mine), 8), dtype=np.uint8)
            key[:, :KEY] = short[mine]
            out.append(stars(key.view("<u8").ravel(), at[mine], labels))
        set_, label, own = (np.concatenate(x) for x in zip(*out, strict=True))
        rows = np.unique((set_.astype(np.int64) << 33) | (label << 1) | own)  # a range has fewer than 2**30 sets
        return pa.table({"a": ids[rows >> 33], "label": (rows >> 1) & 0xFFFFFFFF, "own": (rows & 1) > 0}, schema=schema)

    return docs.select("text").mapInArrow(offer, "range int, keys binary, ids binary, counts binary, labels binary").groupBy("range").applyInArrow(meet, "a long, label long, own boolean")


def candidate_links(docs: DataFrame, percent: int, size: int, ranges: int, hot) -> DataFrame:
    """(a, b): each set and the centres of its stars (the least set that owns a star), but for a star's centre itself."""
    rows = common.materialize(star_rows(docs, percent, size, ranges, hot))
    centres = rows.groupBy("label").agg(F.min(F.when(F.col("own"), F.col("a"))).alias("b"), F.max("a").alias("last"), F.min("a").alias("first")).where("first < last").select("label", "b")
    return rows.join(centres, "label").where("a <> b").select("a", "b").distinct()


def members(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, sid and sketch (null for the empty set) of every row; and, with `often`, shingles that a task has met often, with their number in n_shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.int64()), ("sketch", pa.binary()), ("often", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, n_held, n_docs = Shingler(size), [], 0, 0

        def often() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            good = n >= max(3, HOT * n_docs)
            return pa.RecordBatch.from_pydict({"doc_id": pa.nulls(int(good.sum()), pa.int64()), "n_shingles": n[good], "sid": values[good].view(np.int64), "sketch": pa.nulls(int(good.sum()), pa.binary()), "often": np.ones(int(good.sum()), dtype=bool)}, schema=schema)

        for b in batches:
            sets = []
            for t in common.rows_of(b, "text"):
                s = shingles(t)
                sets.append((len(s), set_id(s) if len(s) else None, sketch(s) if len(s) else None))
                held.append(s)
                n_held, n_docs = n_held + len(s), n_docs + 1
                if n_held > COUNT:
                    yield often()
                    held, n_held, n_docs = [], 0, 0
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_shingles": [s[0] for s in sets], "sid": [s[1] for s in sets], "sketch": [s[2] for s in sets], "often": [False] * len(sets)}, schema=schema)
        yield often()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, sid long, sketch binary, often boolean")


def similar(common_: int, a: int, b: int, percent: int) -> bool:
    return 100 * common_ >= percent * (a + b - common_)


class SignatureTree:
    """Sets by size, in leaves of FAN sets; every node has the OR of the bitmaps below it and the range of their sizes."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.bits, self.sizes = bits[self.order], sizes[self.order]
        ors, low, high = self.bits, self.sizes, self.sizes
        self.levels = [(ors, low, high)]
        while len(ors) > 1:
            cut = np.arange(0, len(ors), FAN)
            ors, low, high = np.bitwise_or.reduceat(ors, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((ors, low, high))

    def below(self, level: int, node: int) -> slice:
        """Places of the sets below a node."""
        width = FAN**level
        return slice(node * width, min((node + 1) * width, len(self.sizes)))


def dual_walk(x: SignatureTree, y: SignatureTree, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (places in x and y as given) that join different components; `component` (of x's sets, then y's) is updated."""
    found, nx = [], len(x.sizes)
    cx, cy = x.order, nx + y.order
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        i, u, j, v = stack.pop()
        su, sv = x.below(i, u), y.below(j, v)
        here = component[np.concatenate([cx[su], cy[sv]])]
        if (here == here[0]).all():
            continue  # linked already
        (ou, lu, hu), (ov, lv, hv) = x.levels[i], y.levels[j]
        most = min(int(np.bitwise_count(ou[u] & ov[v]).sum()), int(hu[u]), int(hv[v]))
        least = (int(lu[u]), int(lv[v]))
        if 100 * int(hv[v]) < percent * least[0] or 100 * int(hu[u]) < percent * least[1] or (100 + percent) * most < percent * sum(least):
            continue
        if i > 1 or j > 1:
            if i >= j:
                stack += [(i - 1, c, j, v) for c in range(u * FAN, min((u + 1) * FAN, len(x.levels[i - 1][1])))]
            else:
                stack += [(i, u, j - 1, c) for c in range(v * FAN, min((v + 1) * FAN, len(y.levels[j - 1][1])))]
            continue
        overlap = np.bitwise_count(x.bits[su][:, None, :] & y.bits[sv][None, :, :]).sum(axis=2, dtype=np.int64)
        for a, b in np.argwhere((100 + percent) * overlap >= percent * (x.sizes[su][:, None] + y.sizes[sv][None, :])):
            p, q = int(x.order[su][a]), int(y.order[sv][b])
            if component[p] != component[nx + q]:
                component[component == component[nx + q]] = component[p]
                found.append((p, q))
    return found


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bit for each shingle that occurs in two sets at least."""
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bit = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[at]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    width = max(1, -(-int((n > 1).sum()) // 64))
    out = np.zeros((len(sets), width), dtype=np.uint64)
    good = bit >= 0
    np.bitwise_or.at(out, (row[good], bit[good] // 64), np.uint64(1) << (bit[good] % 64).astype(np.uint64))
    return out


def parted(links: DataFrame) -> DataFrame:
    """sid, cluster, parts, part and further columns of each set of a star but its centre, which is the cluster: a star has a part for every PART sets. Salted, since one star may hold most sets."""
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")
    big = links.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    big = big.select("b", F.ceil(F.col("n") / PART).cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    parts = F.coalesce("parts", F.lit(1))
    found = links.withColumn("salt", salt).join(big, ["b", "salt"], "left").select(F.col("a").alias("sid"), F.col("b").alias("cluster"), parts.alias("parts"), *links.drop("a", "b").columns)
    return found.withColumn("part", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("parts")).cast("int"))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def centre_links(stars_: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """(a, b): links between sets and the centres of their stars. stars_: cluster, part, sid, near; texts: sid, text (packed); texts move, since their shingles take more room."""
    asked = stars_.where("near").select("cluster", "part", "sid")
    mine = asked.join(texts.withColumnRenamed("text", "mine"), "sid")
    centres = asked.select("cluster", "part").distinct().join(texts.select(F.col("sid").alias("cluster"), F.col("text").alias("theirs")), "cluster")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known, y = Shingler(size), None, np.zeros(0, np.uint64)
        for b in batches:
            good = []
            for cluster, mine_, theirs in common.rows_of(b, "cluster", "mine", "theirs"):
                if cluster != known:
                    known, y = cluster, shingles(common.unpacked(theirs))
                x = shingles(common.unpacked(mine_))
                good.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([b["sid"], b["cluster"]], schema=LINKS).filter(pa.array(good, pa.bool_()))

    return mine.join(centres, ["cluster", "part"]).select("cluster", "sid", "mine", "theirs").mapInArrow(compare, "a long, b long")


TO = ["cluster", "ci", "cj", "i", "j"]


def in_tiles(stars_: DataFrame, percent: int, room: int, *carried: str) -> DataFrame:
    """Rows of the tiles (TO) that compare the sets of a star that aren't near with all of its sets: side (0: not near, 1: all), sid and carried columns. room: shingles of one side.

    stars_: cluster, parts, part, sid, n, near and carried columns.
    """
    # classes of sizes: sets of classes that aren't neighbours are too unlike in size to be similar; a star of one part is one class
    size_class = F.when(F.col("parts") > 1, F.floor(F.log(F.col("n")) / math.log(100 / percent))).otherwise(0).cast("int")
    near = common.materialize(stars_.withColumn("class", size_class))
    blocks = lambda n: F.ceil(n / room).cast("int")
    sizes = near.groupBy("cluster", "parts", "class").agg(F.sum("n").alias("n_all"), F.sum(F.when(~F.col("near"), F.col("n"))).alias("n_loose"))
    wanted = sizes.where(F.col("n_loose") > 0).select("cluster", F.col("class").alias("ci"), blocks(F.col("n_loose")).alias("b_loose"), F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("cj"))
    tiles = wanted.join(sizes.select("cluster", "parts", F.col("class").alias("cj"), blocks(F.col("n_all")).alias("b_all")), ["cluster", "cj"])
    tiles = common.materialize(tiles.select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ci", "cj", "b_loose", "b_all"))
    theirs, mine = tiles.withColumnRenamed("cj", "class"), tiles.withColumnRenamed("ci", "class")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    every = near.join(theirs, ["cluster", "part", "class"]).select("cluster", "ci", F.col("class").alias("cj"), F.explode(spread("b_loose")).alias("i"), place("b_all").alias("j"), "sid", *carried, F.lit(1).alias("side"))
    loose = near.where(~F.col("near")).join(mine, ["cluster", "part", "class"]).select("cluster", F.col("class").alias("ci"), "cj", place("b_loose").alias("i"), F.explode(spread("b_all")).alias("j"), "sid", *carried, F.lit(0).alias("side"))
    return every.unionByName(loose)


def pruned(links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, near: the links (a set and a centre) without which no similar pair loses its star. sets: sid, n, sketch.

    near: by their sketches the set may be similar to the centre. The others may be so to another set of the star.
    """
    centres = sets.select(F.col("sid").alias("cluster"), F.col("n").alias("n_centre"), F.col("sketch").alias("centre"))
    rows = parted(links).join(sets, "sid").join(centres, "cluster")
    kept = "cluster long, parts int, part int, sid long, n long, sketch binary, near boolean"
    names = [c.split()[0] for c in kept.split(", ")]

    def enough(total: int, differ: int) -> bool:
        return (100 + percent) * (total - differ) >= 2 * percent * total

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [enough(n + m, abs(n - m)) and enough(n + m, bits_that_differ(x, y)) for x, n, y, m in common.rows_of(b, "sketch", "n", "centre", "n_centre")]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names[:-1]], pa.array(near, pa.bool_())], names=names)

    def tile(table: pa.Table) -> pa.Table:
        """Sets of the tile that aren't near and may be similar to another of its sets."""
        side, sid, near = (table[c].to_numpy() for c in ("side", "sid", "near"))
        n, sketches = table["n"].to_numpy(), table["sketch"].to_pylist()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = np.zeros(len(sid), dtype=bool)
        if len(left) and len(right):
            good = may_be_similar([sketches[k] for k in left], n[left], [sketches[k] for k in right], n[right], percent)
            good &= sid[left][:, None] != sid[right][None, :]
            found[left], found[right] = good.any(axis=1), good.any(axis=0)
        a = np.unique(sid[found & ~near])
        return pa.table({"a": a, "b": np.full(len(a), table["cluster"][0].as_py(), dtype=np.int64)}, schema=LINKS)

    rows = rows.select("cluster", "parts", "part", "sid", "n", "sketch", "n_centre", "centre").mapInArrow(compare, kept)
    rows = common.materialize(rows)
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    wanted = rows.groupBy("cluster", "parts").agg(F.count("*").alias("m"), F.count_if(~F.col("near")).alias("loose")).where("loose > 0 and m > 1").select("cluster", every_part)
    others = in_tiles(rows.join(wanted, ["cluster", "part"]), percent, SKETCHES, "n", "sketch", "near").groupBy(*TO).applyInArrow(tile, "a long, b long").distinct()
    near = rows.where("near").select(F.col("sid").alias("a"), F.col("cluster").alias("b"), F.lit(True).alias("near"))
    return near.unionByName(others.withColumn("near", F.lit(False)))


def star_links(stars_: DataFrame, linked: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """(a, b): more links within stars whose sets are in several components of `linked` (node, component); with those known they connect each component."""
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    own = stars_.join(linked.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    own = common.materialize(own.select("cluster", "parts", "part", "sid", "n", "component"))
    kinds = own.groupBy("cluster", "parts", "component").agg(F.count("*").alias("m")).groupBy("cluster", "parts").agg(F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("kinds"))
    mixed = kinds.where("kinds > 1").select("cluster", every_part, F.col("most.component").alias("common"))
    near = own.join(mixed, ["cluster", "part"]).withColumn("near", F.col("component") == F.col("common")).drop("common")
    ends = in_tiles(near, percent, TILE, "component").join(texts, "sid")

    def tile(table: pa.Table) -> pa.Table:
        shingles = Shingler(size)
        rows = {(s, d): (c, x) for s, d, c, x in zip(*(table[c].to_pylist() for c in ("side", "sid", "component", "text")), strict=True)}
        left, right = ([k for k in rows if k[0] == side] for side in (0, 1))
        out = []
        if left and right:
            sets_ = [shingles(common.unpacked(rows[k][1])) for k in left + right]
            bits, sizes = bitmaps(sets_), np.array([len(s) for s in sets_])
            at: dict[int, int] = {}  # what is linked already is one component
            component = np.array([at.setdefault(rows[k][0], n) for n, k in enumerate(left + right)])
            m = len(left)
            for p, q in dual_walk(SignatureTree(bits[:m], sizes[:m]), SignatureTree(bits[m:], sizes[m:]), component, percent):
                out.append((left[p][1], right[q][1]))
        return pa.table({"a": [x[0] for x in out], "b": [x[1] for x in out]}, schema=LINKS)

    return ends.groupBy(*TO).applyInArrow(tile, "a long, b long")


def join(docs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark: SparkSession = docs.sparkSession
    common.ship(spark)
    docs = docs.select("doc_id", "text")
    with_id = docs.where(F.col("doc_id").isNotNull())
    both = common.materialize(members(docs, size))
    rows = both.where(~F.col("often")).drop("often")
    ranges = 1 + (rows.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0) // RANGE
    frequent = both.where("often").groupBy("sid").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= F.lit(max(3.0, HOT * rows.count())))
    hot = spark.sparkContext.broadcast(np.sort(frequent.select("sid").toArrow()["sid"].to_numpy().view(np.uint64)))
    least = rows.where(F.col("sid").isNotNull() & F.col("doc_id").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    least = common.materialize(least)
    links = common.materialize(candidate_links(with_id, percent, size, ranges, hot))
    common.release(spark)
    links = common.materialize(pruned(links, least.select("sid", "n", "sketch"), percent))
    common.release(spark)
    least = least.drop("sketch")
    stars_ = common.materialize(parted(links).join(least.select("sid", "n"), "sid"))
    ids = links.select(F.col("a").alias("sid")).unionByName(links.where("near").select(F.col("b").alias("sid"))).distinct()
    chosen = ids.join(least, "sid").select("doc_id", "sid")
    schema = pa.schema([("sid", pa.int64()), ("text", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([common.packed(t) for t in common.rows_of(b, "text")], pa.binary())], names=["doc_id", "text"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for b in batches:
            sets = (shingles(common.unpacked(t)) for t in common.rows_of(b, "text"))
            good = pa.array([len(s) > 0 and set_id(s) == d for s, d in zip(sets, b["sid"].to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["sid"], b["text"]], schema=schema).filter(good)

    # an id may have several rows: equal ones are one (dealt by id already), and those of another set go
    texts = with_id.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, "doc_id long, text binary")
    texts = texts.join(chosen, "doc_id").distinct().select("sid", "text")
    texts = common.materialize(texts.mapInArrow(load, "sid long, text binary").dropDuplicates(["sid"]))
    common.release(spark)
    found = common.materialize(centre_links(stars_, texts, percent, size))
    common.release(spark)
    more = common.materialize(star_links(stars_, components(found), texts, percent, size))
    common.release(spark)
    linked = components(found.unionByName(more))
    first = linked.join(least, linked["node"] == least["sid"]).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = linked.join(first, "component").select(F.col("node").alias("sid"), "component_id")
    by_set = least.join(by_set, "sid", "left").select("sid", F.coalesce("component_id", "doc_id").alias("component_id"))
    rows = rows.drop("sketch")
    found = rows.where(F.col("sid").isNotNull()).join(by_set, "sid", "left")
    empty = rows.where(F.col("sid").isNull()).withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")]
    return found.select(*cols).unionByName(empty.select(*cols))
