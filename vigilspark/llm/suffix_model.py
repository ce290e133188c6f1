"""Language-model scoring by a probabilistic suffix tree.

Symbols are the tokens; a state is a context of up to `depth` tokens (a mark stands before the first). A run of tokens is listed
when it occurs at least `least` times in training, whatever the size of the corpus; a context is a state if
uses * KL(next symbol after it || next symbol after its suffix) is at least `gain` nats. Next-symbol distributions are smoothed: listed continuations
are discounted, and what that and the others leave is shared out by the next shorter kept context, down to the base
distribution. The longest kept suffix scores each token.

The tree grows with the corpus; none of it is collected or broadcast. Runs are 64-bit hashes (word hashes, turned and
joined by exclusive or), so depth has no bound by code size. Texts are chunks of about CHUNK tokens, and the tree is dealt to ranges of hashes. A chunk asks ranges
for the counts of its distinct runs, each once however often it is used, and they answer it with a bit for each and the counts of those listed. A run
can be listed only if the runs without its first and without its last token are, so level by level only those are asked for. Of the chunks that use a run in training, the first
owns it: it adds the run's terms to the sums of its context, and the ranges answer all chunks that have a listed context whether it is kept.
A chunk then has all that it needs to score its own texts. All counts cover all training rows.

Turns bound what lies on disk at once: runs of one and two tokens are counted by shares of the hashes, texts and answers meet by shares of the chunks, longer runs and
contexts are answered by shares of the ranges. Turns together are all of them. Tokens are hashed once and written as numbers within their chunk. Tables are deleted once what is read from them is written.

Null text: empty, just the end token. Repeated rows are scored each, and count each in training. Without training rows
N and V are 0 and every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH, LEAST, GAIN, DISCOUNT = 2, 2, 1.0, 0.5
CHUNK, RANGE = 1_000_000, 3_000_000  # tokens that a task packs together, and that a range of hashes takes; results don't depend on them
MEMO = 200_000  # word hashes that a Python worker remembers
TURNS = 3  # shares of the hashes whose runs of one and two tokens are counted one after the other; results don't depend on it
TREE_TURNS = 5  # shares of the chunks that meet their answers, and of the ranges that answer longer runs and contexts, one after the other
DOCS = 1 << 16  # documents of a chunk at most: their places take two bytes
TURN = 21
START, END = (xxhash.xxh3_64_intdigest(b"\n" + w) for w in (b"start", b"end"))  # no word has a line break

PACKED = "level int, part int, chunk long, runs binary, gaps binary, times binary, sums binary"
ANSWERS = "chunk long, level int, part int, size int, found binary, owned binary, n binary, context binary, tokens long, kinds long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ASKED = ("runs", "gaps", "times", "sums")
TERMS = 5  # sums of a context: its uses, those with listed continuations, their share of the divergence, their probabilities after the shorter context, the same as adjusted


def words(text: str | None) -> list[bytes]:
    """Words between white space (\\x20, \\x09 to \\x0D), A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def turned(x: np.ndarray) -> np.ndarray:
    y = x << np.uint64(TURN)
    y |= x >> np.uint64(64 - TURN)
    return y


def squeezed(x: np.ndarray) -> bytes:
    """The number of values, then zstd of the bytes of one weight together, since high ones are mostly 0."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + (pa.Codec("zstd").compress(planes.tobytes(), asbytes=True) if len(x) else b"")


def loose(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * size, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


CHUNKS = pa.schema([("chunk", pa.int64()), *[(c, pa.binary()) for c in ("ids", "nulls", "held_out", "lengths", "kinds", "tokens")]])


def chunks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, held_out, text) as rows of about CHUNK tokens: ids, their nulls, held-out flags, tokens with both marks; hashes of the words, the most frequent first and in order among those as frequent, as gaps; numbers of the tokens among these.

    Written once, so that all turns have the same chunks whatever order the input comes in.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        held, heads, size = [], [], 0

        def out() -> pa.RecordBatch:
            kinds, at, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), dtype="<u4")
            rank[order] = np.arange(len(order))
            row = {
                "chunk": heads[0][0],
                "ids": np.array([h[1] or 0 for h in heads], dtype=np.int64),
                "nulls": np.array([h[1] is None for h in heads]),
                "held_out": np.array([h[2] for h in heads], dtype=bool),
                "lengths": np.array([len(x) for x in held], dtype=np.int64),
            }
            return pa.RecordBatch.from_pylist([{c: x if c == "chunk" else x.tobytes() for c, x in row.items()} | {"kinds": squeezed(gaps(kinds[order])), "tokens": squeezed(rank[at])}], schema=CHUNKS)

        for b in batches:
            for uid, doc_id, held_out, text in common.rows_of(b, "uid", "doc_id", "held_out", "text"):
                own = words(text)
                x = np.empty(len(own) + 2, dtype=np.uint64)
                x[0], x[-1] = START, END
                x[1:-1] = np.fromiter(map(memo.__getitem__, own), dtype=np.uint64, count=len(own))
                held.append(x)
                heads.append((uid, doc_id, held_out))
                size += len(x)
                if size > CHUNK or len(held) == DOCS:
                    yield out()
                    held, heads, size = [], [], 0
        if held:
            yield out()

    docs = docs.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "held_out", "text")
    return docs.mapInArrow(pack, "chunk long, ids binary, nulls binary, held_out binary, lengths binary, kinds binary, tokens binary")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: hashes of the words; by token the number of its word, its place within its document and whether it is in training; lengths."""
    lengths = np.frombuffer(row["lengths"], dtype=np.int64)
    kinds, at = np.cumsum(loose(row["kinds"], np.uint64)), loose(row["tokens"], np.uint32).astype(np.int32)
    inside = (np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    return kinds, at, inside, np.repeat(~np.frombuffer(row["held_out"], dtype=bool), lengths), lengths


def grouped(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs in order; by run given its number among them; a place of each."""
    order = np.argsort(run)
    own = run[order]
    new = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
    at = np.empty(len(run), dtype=np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return own[new], at, order[new]


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences, which runs in order make smaller than the runs."""
    return np.diff(x, prepend=np.zeros(1, dtype=np.uint64))


def asking(level: int, chunk: int, runs: np.ndarray, times: np.ndarray, parts: int, sums: np.ndarray | None = None, short: bool = True) -> Iterator[pa.RecordBatch]:
    """Runs in order as a row for each range. sums: TERMS rows with a column for each run whose times aren't 0. short: gaps instead of runs, for what is written."""
    schema = pa.schema([("level", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ASKED]])
    cut = np.searchsorted((runs >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
    before = None if sums is None else np.concatenate([[0], np.cumsum(times > 0)])
    rows = [
        {"level": level, "part": k, "chunk": chunk, "runs": None if short else runs[i:j].tobytes(), "gaps": squeezed(gaps(runs[i:j])) if short else None, "times": squeezed(times[i:j]), "sums": None if sums is None else squeezed(np.ascontiguousarray(sums[:, before[i] : before[j]]).ravel())}
        for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True))
        if j > i
    ]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def packed(table: DataFrame, levels: int, parts: int, held: bool, now: int, turns: int) -> DataFrame:
    """What chunks ask first: their distinct runs of 1 to `levels` tokens of turn `now`, in order, with their uses in training rows, by level (their length) and range of hashes.

    table: chunks(). parts: ranges of a turn. held: also runs that only held-out rows use.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b[c][k].as_py() for c in CHUNKS.names}
                kinds, word, inside, taught, _ = opened(row)
                a = kinds[word]
                run = np.zeros(len(a), dtype=np.uint64)
                for level in range(1, levels + 1):
                    run = turned(np.concatenate([np.zeros(1, dtype=np.uint64), run[:-1]])) ^ a if level > 1 else a
                    good = (inside >= level - 1) & ((run >> np.uint64(32)) * np.uint64(turns) >> np.uint64(32) == now)
                    if not held:
                        good &= taught
                    own, at, _ = grouped(run[good])
                    yield from asking(level, row["chunk"], own, np.bincount(at[taught[good]], minlength=len(own)).astype(np.int32), parts * turns, short=False)

    return table.mapInArrow(pack, PACKED)


def answered(asked: DataFrame, least: int, gain: float) -> DataFrame:
    """Answers of the ranges, a row for each of those asked. Counts: whether each run is listed (all words of training are, longer runs from `least` uses), and of
    those the uses and whether the chunk owns it; the first row for words has the range's tokens and words. Contexts (level below 0): whether each is kept, and what that gives tokens not listed after it, as log10 over the base."""
    schema = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("size", pa.int32()), *[(c, pa.binary()) for c in ("found", "owned", "n", "context")], ("tokens", pa.int64()), ("kinds", pa.int64())])
    tiny = 1e-12

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        level, rows = key[0].as_py(), sorted(t.select(["chunk", *ASKED]).to_pylist(), key=lambda r: r["chunk"])
        times = [loose(r["times"], np.int32) for r in rows]
        ends, times = np.cumsum([0, *map(len, times)]), np.concatenate(times)
        run = np.concatenate([np.frombuffer(r["runs"], dtype=np.uint64) if r["gaps"] is None else np.cumsum(loose(r["gaps"], np.uint64)) for r in rows])
        order = np.argsort(run, kind="stable")
        sought, uses = run[order], times[order].astype(np.int64)
        new = np.concatenate([[True], sought[1:] != sought[:-1]])
        first, group = np.flatnonzero(new), np.empty(len(run), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        if level > 0:
            n = np.add.reduceat(uses, first)
            good = n >= (1 if level == 1 else least)
            owners = np.minimum.reduceat(np.where(uses > 0, np.arange(len(uses)), len(uses)), first)
            owned = np.zeros(len(run), dtype=bool)
            owned[order[owners[good]]] = True
            mine = good & (sought[first] != np.uint64(START))
        else:
            sums = np.zeros((TERMS, len(run)))
            sums[:, times > 0] = np.concatenate([loose(r["sums"], np.float64).reshape(TERMS, -1) for r in rows], axis=1)
            total = np.maximum.reduceat(sums[0][order], first)
            listed, kl, above, below = (np.add.reduceat(x[order], first) for x in sums[1:])
            n = np.add.reduceat(uses, first)
            rest = total - listed  # what isn't listed after the context is one more event
            with np.errstate(divide="ignore", invalid="ignore"):
                kl = kl + np.where(rest > 0, rest * np.log(rest / total / np.maximum(1 - above, 1e-9)), 0.0)
                good = (n > 0) & (kl >= gain)
                others = np.log10(np.maximum(tiny, 1 - (listed - DISCOUNT * n) / total) / np.maximum(tiny, 1 - below))
        out = []
        for k, (r, i, j) in enumerate(zip(rows, ends[:-1], ends[1:], strict=True)):
            found, of = good[group[i:j]], group[i:j]
            row = {"chunk": r["chunk"], "level": level, "part": key[1].as_py(), "size": int(j - i), "found": np.packbits(found).tobytes(), "owned": None, "n": None, "context": None, "tokens": 0, "kinds": 0}
            if level > 0:
                row |= {"owned": np.packbits(owned[i:j][found]).tobytes(), "n": squeezed(n[of[found]])}
                if level == 1 and not k:
                    row |= {"tokens": int(n[mine].sum()), "kinds": int(mine.sum())}
            else:
                row["context"] = squeezed(others[of[found]])
            out.append(row)
        return pa.Table.from_pylist(out, schema=schema)

    return asked.groupBy("level", "part").applyInArrow(answer, ANSWERS)


def longer(levels: list, a: np.ndarray, inside: np.ndarray) -> SimpleNamespace:
    """Runs one token longer than the last of the levels that may be listed, all at two tokens: hashes in order; by token the number of the run that ends there, or -1; numbers of each one's context and suffix."""
    last, size = levels[-1], len(levels)
    good = inside >= size
    good[1:] &= (last.at[1:] >= 0) & (last.at[:-1] >= 0)
    if size > 1:
        listed = np.append(last.found, False)[last.at]
        good &= listed
        good[1:] &= listed[:-1]
    good = np.flatnonzero(good)
    run = turned(last.kinds[last.at[good - 1]])
    run ^= a[good]
    kinds, own, place = grouped(run)
    at = np.full(len(a), -1, dtype=np.int32)
    at[good] = own
    return SimpleNamespace(kinds=kinds, at=at, context=last.at[good[place] - 1], suffix=last.at[good[place]], word=levels[0].at[good[place]] if levels else None)


def judged(row: dict, answers: pa.Table, depth: int, n_all: int, n_kinds: int) -> tuple[list, list]:
    """Levels 1 to `depth` of a chunk with the answers so far, and by token its hash, its place, whether it is in training, and lengths. By run: found, owned, n; p, its last token's probability after its context
    by plain counts; a, the adjustment of that token after the context; value, what a use adds to that of the context and shorter ones; others, what it adds as a context (nan: not kept)."""
    words, word, inside, taught, lengths = opened(row)
    by: dict[int, list[dict]] = {}
    for r in sorted(answers.to_pylist(), key=lambda r: r["part"]):
        by.setdefault(r["level"], []).append(r)
    bits = lambda level, column, sizes: np.concatenate([np.zeros(0, dtype=bool), *[np.unpackbits(np.frombuffer(r[column], dtype=np.uint8), count=int(n)).astype(bool) for r, n in zip(by.get(level, []), sizes, strict=True)]])
    values = lambda level, column, kind: np.concatenate([np.zeros(0, dtype=kind), *[loose(r[column], kind) for r in by.get(level, [])]])
    order = np.argsort(words)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    levels, a = [], words[word]
    for level in range(1, depth + 1):
        x = longer(levels, a, inside) if levels else SimpleNamespace(kinds=words[order], at=rank[word])
        x.found = bits(level, "found", [r["size"] for r in by.get(level, [])])
        assert len(x.found) == len(x.kinds), "answers are for other runs"
        listed = np.flatnonzero(x.found)
        x.owned = listed[bits(level, "owned", [np.unpackbits(np.frombuffer(r["found"], dtype=np.uint8), count=r["size"]).sum() for r in by.get(level, [])])]
        x.n = np.zeros(len(x.kinds), dtype=np.int64)
        x.n[listed] = values(level, "n", np.int64)
        x.a, x.value, x.others = np.zeros(len(x.kinds)), np.zeros(len(x.kinds)), np.full(len(x.kinds), np.nan)
        if levels:
            last = levels[-1]
            x.p = np.zeros(len(x.kinds))
            total, prob, below, others = last.n[x.context[listed]], levels[0].p[x.word[listed]], last.a[x.suffix[listed]], last.others[x.context[listed]]
            x.p[listed] = x.n[listed] / total
            own, kept = np.log10((x.n[listed] - DISCOUNT) / total / prob), ~np.isnan(others)
            x.a[listed] = np.where(kept, own, below)
            x.value[listed] = np.where(kept, own - others - below, 0.0)
        else:
            x.p = (x.n + 1) / (n_all + n_kinds + 1)
        x.asked = np.flatnonzero(x.found & (x.n > 1))  # as contexts
        kept = bits(-level, "found", [r["size"] for r in by.get(-level, [])])
        if len(kept):
            x.others[x.asked[kept]] = values(-level, "context", np.float64)
        levels.append(x)
    return levels, [a, inside, taught, lengths]


def meeting(texts: DataFrame, answers: DataFrame, use, schema: str) -> DataFrame:
    """Chunks and all their answers in one place, by shares of the chunks: the rows that `use` makes of them, written."""
    out = None
    for now in range(TREE_TURNS):
        t, v = (x.where(F.pmod(F.xxhash64("chunk"), F.lit(TREE_TURNS)) == now) for x in (texts, answers))
        share = common.materialize(t.groupBy("chunk").cogroup(v.groupBy("chunk")).applyInArrow(use, schema))
        common.release(texts.sparkSession)
        out = share if out is None else out.unionByName(share)
    return out


def ask(texts: DataFrame, answers: DataFrame, level: int, depth: int, parts: int, n_all: int, n_kinds: int) -> DataFrame:
    """What chunks ask when runs of up to `level` tokens are counted: runs one token longer, and contexts one shorter with the sums of the runs of `level` tokens that they own."""

    def use(t: pa.Table, v: pa.Table) -> pa.Table:
        row = t.to_pylist()[0]
        levels, (a, inside, taught, _) = judged(row, v, level, n_all, n_kinds)
        out, last, x = [], levels[-2], levels[-1]
        context, suffix = x.context[x.owned], x.suffix[x.owned]
        n, total, q = x.n[x.owned], last.n[context], last.p[suffix]
        size = len(last.kinds)
        kl, above, below = (np.bincount(context, weights=w, minlength=size) for w in (n * np.log(n / total / q), q, levels[0].p[x.word[x.owned]] * 10 ** last.a[suffix]))
        listed, times = np.bincount(context, weights=n, minlength=size), np.bincount(context, minlength=size).astype(np.int32)
        own = last.asked[times[last.asked] > 0]
        out += asking(1 - level, row["chunk"], last.kinds[last.asked], times[last.asked], parts, np.stack([last.n[own].astype(np.float64), *(w[own] for w in (listed, kl, above, below))]))
        if level <= depth:
            more = longer(levels, a, inside)
            at = more.at[taught]
            out += asking(level + 1, row["chunk"], more.kinds, np.bincount(at[at >= 0], minlength=len(more.kinds)).astype(np.int32), parts)
        empty = pa.schema([("level", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ASKED]])
        return pa.Table.from_batches(out, schema=empty)

    return meeting(texts, answers, use, PACKED)


def report(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN) -> DataFrame:
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select("doc_id", "text", (common.fold(F.col("doc_id"), 7) == 2).alias("held_out"))
    chars = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = 1 + chars // 6 // RANGE // TURNS
    least = max(2, least)
    texts, tables = common.materialize(chunks(docs)), []

    def answers() -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    for now in range(TURNS):
        tables.append(common.materialize(answered(packed(texts, min(2, depth + 1), parts, True, now, TURNS), least, gain)))
        common.release(spark)
    sums = answers().agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    n_all, n_kinds = sums["n"], sums["v"]
    per_token = math.log10(n_all + 1 * (n_kinds + 1))
    for level in range(2, depth + 2):
        asked = ask(texts, answers(), level, depth, parts * TURNS, n_all, n_kinds)
        for now in range(TREE_TURNS):
            tables.append(common.materialize(answered(asked.where(F.pmod("part", F.lit(TREE_TURNS)) == now), least, gain)))
            common.release(spark)
        common.discard(asked)

    def score(t: pa.Table, v: pa.Table) -> pa.Table:
        row = t.to_pylist()[0]
        levels, (_, inside, _, lengths) = judged(row, v, depth + 1, n_all, n_kinds)
        place, words = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), levels[0]
        total = lambda x: np.bincount(place, weights=x, minlength=len(lengths))
        base = total(np.where(inside > 0, np.log10(words.n + 1)[words.at], 0.0)) - (lengths - 1) * per_token
        known = total((inside > 0) & (words.n > 0)[words.at]).astype(np.int64)
        value = sum(total(np.append(np.nan_to_num(x.others) + x.value, 0.0)[x.at]) for x in levels)
        ids, nulls, held_out = (np.frombuffer(row[c], dtype=k) for c, k in (("ids", np.int64), ("nulls", bool), ("held_out", bool)))
        return pa.table([pa.array(ids, mask=nulls), pa.array(held_out), pa.array(lengths - 1), pa.array(known), pa.array(np.full(len(ids), n_all, dtype=np.int64)), pa.array(base), pa.array(base + value)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = meeting(texts, answers(), score, SCORES)
    for t in [texts, *tables]:
        common.discard(t)
    return out


class Tree:
    """The tree in memory, for small tables: what report() sums up by joins. An adjustment is log10 of a token's probability over its base probability."""

    def __init__(self, levels: list[dict[int, tuple[float, dict[int, int]]]], base: int, prob: dict[int, float]):
        self.base, self.prob = base, prob
        self.levels: list[dict[int, tuple[float, dict[int, float]]]] = []  # by length: context -> (adjustment of others, of listed ones)
        for size, contexts in enumerate(levels, 1):
            out = {}
            for context, (total, counts) in contexts.items():
                p = {w: (n - DISCOUNT) / total for w, n in counts.items()}
                suffix = context % base ** (size - 1) if size > 1 else None
                below = {w: self.prob[w] * 10 ** self.adjust(suffix, size - 1, w) for w in counts}
                others = math.log10(max(1e-12, 1 - sum(p.values())) / max(1e-12, 1 - sum(below.values())))
                out[context] = (others, {w: math.log10(x / self.prob[w]) for w, x in p.items()})
            self.levels.append(out)

    def adjust(self, context: int | None, size: int, w: int) -> float:
        """By the longest kept suffix of a context of `size` listed tokens."""
        total = 0.0
        while size:
            found = self.levels[size - 1].get(context)
            if found is not None:
                x = found[1].get(w)
                if x is not None:
                    return total + x
                total += found[0]
            size -= 1
            context = context % self.base**size if size else None
        return total
