"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

The last token of a prefix fixes its encoding: what comes before that token is the encoding of a shorter prefix. So the
encoder keeps one token for each node of a trie of distinct words, set when the node is reached depth first from its
parent, and shared prefixes are encoded once. A token may end a prefix when it and the last token of the rest stay apart
under the merge rules.

Texts: null counts as empty; the empty text has no tokens. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The pre-tokenizer pattern of this public vocabulary.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Characters encoded together, and chunks that a Python worker remembers before it starts afresh; results don't depend on them.
BATCH_CHARS, MAX_CHUNKS = 4_000_000, 800_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file; one per Python worker."""

    def __init__(self, path: str, trie: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.ids = {raw(k): v for k, v in model["vocab"].items()}
        self.bytes_of = {v: k for k, v in self.ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.merge: dict[tuple[int, int], int] = {}  # pair -> merged token
        self.parts: dict[int, tuple[int, int]] = {}  # merged token -> pair
        self.rank = {self.ids[bytes([b])]: -1 for b in range(256)}
        for n, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            t = self.ids[a + b]
            self.merge[self.ids[a], self.ids[b]] = t
            self.parts.setdefault(t, (self.ids[a], self.ids[b]))
            self.rank.setdefault(t, n)
        self.longest_with: dict[bytes, int] = {}  # last three bytes -> length of the longest token that ends so
        for token in self.ids:
            if len(token) > 2:
                self.longest_with[token[-3:]] = max(len(token), self.longest_with.get(token[-3:], 0))
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.library = None if trie else tiktoken.Encoding(path, pat_str=SPLIT.pattern, mergeable_ranks=self.ids, special_tokens={})
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.fresh()

    def fresh(self) -> None:
        self.chunks: dict[str, bytes] = {}  # what stands between two single spaces -> its ids; none: they depend on its neighbours

    # -- when two tokens stay apart

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens."""
        key = left << 20 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            known = self.apart[key] = self.seam_holds(left, right)
        return known

    def seam_holds(self, left: int, right: int) -> bool:
        """Undo the merges on both sides of the seam, youngest first; it breaks if a pair across it would have merged before the merge undone last."""
        limit, rank = 1 << 40, self.rank
        while True:
            t = self.merge.get((left, right))
            if t is not None and 2 * rank[t] < limit:
                return False
            undo = max(rank[left], rank[right])
            if undo < 0:
                return True
            if rank[left] > rank[right]:  # of two equal merges, the left one comes first
                limit, left = 2 * undo, self.parts[left][1]
            else:
                limit, right = 2 * undo + 1, self.parts[right][0]

    def is_whole(self, token: int) -> bool:
        """Whether the token's bytes are encoded as the token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.table[token]) == [token]
        return known

    def merged(self, data: bytes) -> list[int]:
        """The merge rules applied in their order, for the short texts of two tokens."""
        out = [self.ids[bytes([b])] for b in data]
        while len(out) > 1:
            best, at = None, -1
            for k in range(len(out) - 1):
                t = self.merge.get((out[k], out[k + 1]))
                if t is not None and (best is None or self.rank[t] < self.rank[best]):
                    best, at = t, k
            if best is None:
                break
            pair, k, nxt = (out[at], out[at + 1]), 0, []
            while k < len(out):
                if k + 1 < len(out) and (out[k], out[k + 1]) == pair:
                    nxt.append(best)
                    k += 2
                else:
                    nxt.append(out[k])
                    k += 1
            out = nxt
        return out

    def last_token(self, word: bytes, end: int, path: list[int]) -> int:
        """The last token of word[:end]; path[n] is that of word[:n]. There is just one, so what is likely comes first: the last token of word[:end - 1], one byte longer."""
        ids, apart = self.ids, self.apart
        likely = end - 1 - len(self.table[path[-1]]) if end > 1 else 0
        for start in (likely, *range(end - 1, max(0, end - self.longest_with.get(word[end - 3 : end], 2)) - 1, -1)):
            t = ids.get(word[start:end])
            if t is None:
                continue
            if not start:
                if self.is_whole(t):
                    return t
            else:
                known = apart.get(path[start] << 20 | t)
                if known or known is None and self.stays_apart(path[start], t):
                    return t
        raise ValueError(f"no token ends {word[:end]!r}")

    # -- words

    def words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of distinct words. Sorted words are a depth-first walk of their trie: path holds the states from the root to the node at hand, and a word goes on from the longest prefix shared with the word before."""
        out, path, before, table = {}, [-1], b"", self.table
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                path.append(self.last_token(data, end, path))
            ids, end, before = [], len(data), data
            while end:
                ids.append(path[end])
                end -= len(table[path[end]])
            ids.reverse()
            out[word] = array("I", ids).tobytes()
        return out

    def learn(self, chunks: set[str]) -> None:
        """A chunk stands after a single space, which belongs to its first word. Those that begin or end with white space depend on their neighbours."""
        if self.library:
            encode = self.library.encode_ordinary
            for c in chunks:
                self.chunks[c] = array("I", encode(" " + c)).tobytes() if c and not c[0].isspace() and not c[-1].isspace() else b""
            return
        parts = {c: SPLIT.findall(" " + c) for c in chunks if c and not c[0].isspace() and not c[-1].isspace()}
        known = self.words({w for words in parts.values() for w in words})
        for c in chunks:
            self.chunks[c] = b"".join(map(known.__getitem__, parts[c])) if c in parts else b""

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.chunks) > MAX_CHUNKS:
            self.fresh()
        get, todo, new, odd = self.chunks.get, [], set(), set()
        for k, t in enumerate(texts):
            for p in self.added_split.split(t) if self.added_split and "<" in t else (t,):
                first, *chunks = p.split(" ")
                ids = list(map(get, chunks))
                if None in ids:
                    new.update(c for c, x in zip(chunks, ids, strict=True) if x is None)
                    ids = None
                todo.append((k, p, first, chunks if ids is None else None, ids))
        self.learn(new)
        for n, (k, p, first, chunks, ids) in enumerate(todo):
            if p in self.added:
                todo[n] = (k, None, [array("I", [self.added[p]]).tobytes()])
                continue
            ids = list(map(get, chunks)) if ids is None else ids
            lone = b"" not in ids and not first[-1:].isspace()  # else a chunk depends on its neighbours
            words = SPLIT.findall(first if lone else p)
            odd.update(words)
            todo[n] = (k, words, ids if lone else [])
        known, out = self.words(odd), [[] for _ in texts]
        for k, words, ids in todo:
            out[k] += [*map(known.__getitem__, words or ()), *ids]
        return list(map(b"".join, out))

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def encode_each(self, texts) -> Iterator[bytes]:
        """encode_batch over as many texts as BATCH_CHARS holds, again and again."""
        batch, size = [], 0
        for t in texts:
            if batch and size + len(t) > BATCH_CHARS:
                yield from self.encode_batch(batch)
                batch, size = [], 0
            batch.append(t)
            size += len(t)
        yield from self.encode_batch(batch)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_CODECS: dict[tuple[str, bool], Codec] = {}


def codec(path: str, trie: bool = True) -> Codec:
    """One for each Python worker. Without the trie, words that a worker hasn't met are encoded by a public library, for operators that only need ids."""
    if (path, trie) not in _CODECS:
        _CODECS[path, trie] = Codec(path, trie)
    return _CODECS[path, trie]


def encode(text: Column, path: str) -> Column:
    """Ids of each whole text, as array<int>."""

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for s in texts:
            yield pd.Series([np.frombuffer(x, "<u4").astype("int32") for x in c.encode_each(s)])

    return run(common.whole(text))


def decode(ids: Column, path: str) -> Column:
    """The text of each list of ids; a null list gives null."""

    @F.pandas_udf("string")
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for s in lists:
            yield pd.Series([None if x is None else c.decode(np.asarray(x, dtype="<u4").tobytes()) for x in s], dtype=object)

    return run(ids)


def digests(text: Column, path: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of each text: encoded, then decoded, without shipping the ids to the JVM."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for s in texts:
            rows = []
            for ids in c.encode_each(s):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], dtype=object)

    return run(common.whole(text))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Each document encoded and decoded; no shuffle, one pass over the texts."""
    common.ship(docs.sparkSession)
    return docs.select("doc_id", digests(F.col("text"), path).alias("d")).select("doc_id", "d.*")
