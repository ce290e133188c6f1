r"""Conversation prefix trie: every distinct beginning of a conversation is a node, with what sharing it saves.

Conversations become keys: 16 bytes for each turn, a digest of its role and text. Equal keys are one sequence with a count. Sequences
are sorted by key into range partitions. Within a partition, the common depth of sorted neighbours is an edge;
edges are taken by descending depth and their ends merged (union-find). Each merge, or merge of several at a depth, is a
branching node; the nodes on the way up to the next merge have the same members. All that is returned is a sum or minimum
over the sequences below a node: `n_leaves` counts those that no longer one continues, `n_children` those that make a new node
one turn below, `saved_tokens` is words of all members below less words of the nodes there, each once.

A node on the first or the last sequence of a partition may go on in the next one. The partition's forest is contracted to
these two paths; their nodes are given as partial sums, with a digest of the prefix, and merged across partitions by it. What a
partition can't know, the depth that it shares with the partition before, comes from the first and last keys of all
partitions: one row for each. Nodes below a path find their parent by (partition, digest), so children of a common node
stay dealt as the partitions are.

Turns of a conversation are sorted by turn (null first), then by digest; repeated rows are turns of their own. Null role or text is
empty. The block of a negative id is that of SQL: the remainder has the sign of the id. Rows without a conv_id belong to no conversation and don't count. Texts are read once, whole, and not shuffled. An empty
table gives no rows, not even a root. A conversation's key is one value in memory: 16 bytes for each of its turns.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]++"
SIZE = 16  # bytes of a turn's digest
IDS = 4096  # ids in a piece of a list, about


def digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn; the length of the role keeps ("a", "bc") and ("ab", "c") apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def rebuilt(conversations: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, turns array<struct<digest, words>>: each conversation with the first turns of its block's first one in place of its own."""
    c = F.col("conv_id")
    role, text = common.whole(F.col("role")), common.whole(F.col("text"))
    turns = conversations.where(c.isNotNull()).select(
        c.cast("long").alias("conv_id"), (c - c % block).cast("long").alias("base"), F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    # both groupings are by the block, so turns are shuffled once
    each = turns.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(F.struct("known", "turn", "digest", "words"))).alias("own"))
    each = each.select("base", "conv_id", F.transform("own", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("own"))
    first = F.max(F.when(c == F.col("base"), F.slice("own", 1, heads - 1))).over(Window.partitionBy("base"))
    h = common.fold(c, heads).cast("int")
    each = each.select("conv_id", "own", F.coalesce(first, F.array().cast("array<struct<digest: binary, words: bigint>>")).alias("first"))
    return each.select("conv_id", F.concat(F.slice("first", F.lit(1), h), F.slice("own", h + 1, F.size("own"))).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """key, words (of each turn), n (conversations), conv_id (the least), ends (SHA-256 of their ids, comma-joined): one row for each distinct sequence.

    The ids of a sequence with very many conversations are put together in pieces by ranges of the id, and the pieces are read in order, so that no list is whole in memory.
    """
    spark = conversations.sparkSession
    common.ship(spark)
    every = rebuilt(conversations).select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    known = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("double").alias("_id"))
    buckets = max(1, min(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), known.count() // IDS))
    bounds = sorted(set(known.approxQuantile("_id", [k / buckets for k in range(1, buckets)], 0.2 / buckets))) if buckets > 1 else []
    if bounds:
        every = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_id", outputCol="bucket").transform(every.withColumn("_id", F.col("conv_id").cast("double"))).drop("_id")
    else:
        every = every.withColumn("bucket", F.lit(0.0))
    every = every.withColumn("same", F.md5("key"))
    # ids within the longs' order are joined as text
    pieces = every.groupBy("same", "bucket").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"), F.first("key").alias("key"), F.first("words").alias("words"))
    pieces = pieces.select("same", "bucket", "key", "words", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("conv_id"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = pieces.repartition("same").sortWithinPartitions("same", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("words", pa.list_(pa.int64())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
        held = None  # same, key, words, n, conv_id, hash
        out: list[tuple] = []
        done = lambda h: (h[1], h[2], h[3], h[4], h[5].hexdigest())
        pack = lambda rows: pa.RecordBatch.from_pydict({f.name: [r[k] for r in rows] for k, f in enumerate(schema)}, schema=schema)
        for batch in batches:
            for same, key, words, n, conv, ids in common.rows_of(batch, "same", "key", "words", "n", "conv_id", "ids"):
                if held is not None and held[0] == same:
                    held[3] += n
                    held[5].update(b"," + ids.encode())
                    continue
                if held is not None:
                    out.append(done(held))
                held = [same, key, words, n, conv, hashlib.sha256(ids.encode())]
            if len(out) >= 1000:
                yield pack(out)
                out = []
        if held is not None:
            out.append(done(held))
        yield pack(out)

    return dealt.mapInArrow(run, "key binary, words array<bigint>, n bigint, conv_id bigint, ends string")


def common_depth(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their beginning."""
    if not a or not b:
        return 0
    m = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, m), np.frombuffer(b, np.uint8, m)
    other = np.flatnonzero(x != y)
    return (m if len(other) == 0 else int(other[0])) // SIZE


def names(key: bytes) -> list[bytes]:
    """What the prefixes of a key, of no turns and on, are called between partitions."""
    h = hashlib.md5()
    out = [h.digest()]
    for k in range(0, len(key), SIZE):
        h.update(key[k : k + SIZE])
        out.append(h.digest())
    return out


class Group(NamedTuple):
    """Sums over the sequences of a union-find component, sorted places low to high."""

    low: int
    high: int
    n: int
    conv_id: int
    leaves: int  # sequences that none continues; the partition's last one isn't judged
    below: int  # words of all members
    made: int  # words of the nodes that its sequences make, but for the partition's first one


KINDS = [
    ("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
    ("part", pa.int32()), ("name", pa.binary()), ("parent", pa.binary()), ("first", pa.bool_()), ("last", pa.bool_()), ("key", pa.binary()), ("last_key", pa.binary()), ("sums", pa.list_(pa.int64())),
]
SCHEMA = (
    "kind string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends string, part int, name binary, parent binary, first boolean, last boolean, "
    "key binary, last_key binary, sums array<bigint>"
)


def forest(part: int, rows: list[tuple]) -> Iterator[tuple]:
    """Rows of KINDS for one sorted partition of (key, words, n, conv_id, ends): its closed nodes, its open ones as partial sums, and its bounds.

    kind: "node" closed, parent known; "under" closed, parent open; "open" partial; "bound" the first and last keys.
    """
    m = len(rows)
    sums = [np.concatenate([[0], np.cumsum(np.asarray(w, dtype=np.int64))]) for _, w, _, _, _ in rows]
    length = [len(w) for _, w, _, _, _ in rows]
    shared = [0, *[common_depth(rows[i - 1][0], rows[i][0]) for i in range(1, m)], 0]  # shared[i]: of i - 1 and i
    first, last = rows[0][0], rows[-1][0]
    alike = common_depth(first, last)
    on_first, on_last = names(first), names(last)

    parent, group = list(range(m)), [None] * m
    for i, (_, _, n, conv, _) in enumerate(rows):
        leaf = int(i < m - 1 and shared[i + 1] < length[i])
        made = 0 if i == 0 else int(sums[i][-1] - sums[i][shared[i]])
        group[i] = Group(i, i, n, conv, leaf, int(n * sums[i][-1]), made)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    waiting: dict[int, list] = {}  # by component: rows of its topmost closed node, waiting for their parent's least conversation

    def climb(root: int, top: int, bottom: int, branches: int) -> Iterator[tuple]:
        """The nodes of a component from its deepest, of depth `top`, up to below `bottom`; `branches`: children of the deepest one in this partition."""
        g = group[root]
        s = sums[g.low]
        for d in range(top, bottom, -1):
            before = int(s[max(d - 1, 0)])
            # words that the low sequence makes above this subtree don't count; it makes them down from the depth that it shares with the one before
            above = 0 if g.low == 0 else int(s[max(d - 1, 0)] - s[min(shared[g.low], max(d - 1, 0))])
            made = g.made - above
            saved = g.below - g.n * before - made
            ends = rows[g.low][4] if length[g.low] == d else None
            children = branches if d == top else 1
            is_first, is_last = g.low == 0, g.high == m - 1
            held = waiting.pop(root, None)
            if is_first or is_last:
                path = on_first if is_first else on_last
                if held:
                    yield from (("under", *r[1:], part, path[d], None, None, None, None, None, None) for r in held)
                # children on a path are open themselves; both paths may go through one of them
                goes_first, goes_last = is_first and length[0] > d, is_last and length[m - 1] > d
                closed = children - goes_first - goes_last + (goes_first and goes_last and alike > d)
                sure = [int(sums[0][-1]), before] if is_first else None
                yield ("open", g.conv_id, d, None, g.n, closed, g.leaves, saved, ends, part, path[d], path[d - 1] if d else None, is_first, is_last, None, None, sure)
            else:
                if held:
                    yield from (("node", r[1], r[2], g.conv_id, *r[4:], part, None, None, None, None, None, None, None) for r in held)
                waiting[root] = [("node", g.conv_id, d, None, g.n, children, g.leaves, saved, ends)]

    by_depth: dict[int, list[int]] = {}
    for i in range(1, m):
        by_depth.setdefault(shared[i], []).append(i)
    # single sequences first: their own nodes, down to below what they share with a neighbour
    for i in range(m):
        upto = max(shared[i], shared[i + 1])
        yield from climb(i, length[i], upto if m > 1 else -1, 0)
    for depth in sorted(by_depth, reverse=True):
        edges = by_depth[depth]
        touched: dict[int, list] = {}
        for i in edges:
            a, b = find(i - 1), find(i)
            ga, gb = group[a], group[b]
            held = [*waiting.pop(a, []), *waiting.pop(b, [])]
            parent[b] = a
            group[a] = Group(min(ga.low, gb.low), max(ga.high, gb.high), ga.n + gb.n, min(ga.conv_id, gb.conv_id), ga.leaves + gb.leaves, ga.below + gb.below, ga.made + gb.made)
            waiting[a] = held
        for i in edges:
            touched.setdefault(find(i), []).append(i)
        for root, here in touched.items():
            g = group[root]
            upto = max(shared[g.low] if g.low > 0 else -1, shared[g.high + 1] if g.high < m - 1 else -1)
            # a child for each sequence that makes a node one turn below: the low one unless it ends here, and the higher end of each edge
            yield from climb(root, depth, upto, len(here) + int(length[g.low] > depth))
    yield ("bound", None, length[0], None, None, None, None, None, None, part, None, None, None, None, first, last, [int(x) for x in sums[0]])


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node, as the module says."""
    rows = common.materialize(sequences(conversations))
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, part = pa.schema(KINDS), [], 0
        for batch in batches:
            for *row, part in common.rows_of(batch, "key", "words", "n", "conv_id", "ends", "part"):  # noqa: B007
                held.append(row)
        if not held:
            return
        out = []
        for row in forest(part, held):
            out.append(row)
            if len(out) >= 10000:
                yield pa.RecordBatch.from_pydict({f.name: [r[k] for r in out] for k, f in enumerate(schema)}, schema=schema)
                out = []
        yield pa.RecordBatch.from_pydict({f.name: [r[k] for r in out] for k, f in enumerate(schema)}, schema=schema)

    found = common.materialize(dealt.mapInArrow(run, SCHEMA))
    return merged(found)


def merged(found: DataFrame) -> DataFrame:
    """The forests of all partitions as one trie."""
    # the depth that a partition shares with the one before, and the one after: a row for each partition
    order = Window.orderBy("part")
    bounds = found.where("kind = 'bound'").select("part", "depth", "key", "last_key", "sums", F.lag("last_key").over(order).alias("before"), F.lead("key").over(order).alias("after"))
    deep = F.udf(lambda a, b: common_depth(a, b) if a is not None and b is not None else -1, "int")
    last_depth = (F.length("last_key") / SIZE).cast("long")
    bounds = bounds.select("part", F.col("depth").alias("first_depth"), last_depth.alias("last_depth"), deep("before", "key").alias("low"), deep("last_key", "after").alias("high"), "sums")
    bounds = bounds.withColumn("low_sum", F.element_at("sums", F.greatest(F.col("low"), F.lit(0)) + 1)).drop("sums")
    d = F.col("depth")
    partial = found.where("kind = 'open'").join(bounds, "part")
    # the first sequence makes the nodes below what it shares with the partition before; the last is a leaf unless the next partition continues it
    up = F.greatest(d - 1, F.lit(0))
    made = F.when(F.col("first"), F.element_at("sums", 1) - F.when(F.col("low") > up, F.col("low_sum")).otherwise(F.element_at("sums", 2))).otherwise(0)
    leaf = F.when(F.col("last") & (F.col("high") < F.col("last_depth")), 1).otherwise(0)
    partial = partial.select("part", "name", "parent", "depth", "conv_id", "n_convs", "n_children", (F.col("n_leaves") + leaf).alias("n_leaves"), (F.col("saved") - made).alias("saved"), "ends")
    nodes = common.materialize(
        partial.groupBy("name", "depth").agg(
            F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
            F.max("ends").alias("ends"), F.collect_set("part").alias("parts"),
        )
    )
    below = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("open")).withColumnRenamed("parent", "name")
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shape = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    top = nodes.join(below, "name", "left").join(above, "parent", "left").withColumn("n_children", F.col("closed") + F.coalesce("open", F.lit(0))).select(*shape)
    parents = nodes.select(F.explode("parts").alias("part"), "name", F.col("conv_id").alias("parent_conv_id"))
    under = found.where("kind = 'under'").drop("parent_conv_id").join(parents, ["part", "name"]).select(*shape)
    every = found.where("kind = 'node'").select(*shape).unionByName(under).unionByName(top)
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
