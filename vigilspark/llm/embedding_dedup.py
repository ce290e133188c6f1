"""Near-duplicate embeddings of a label, by int8 tile products with rigorous error bounds.

Vectors are scaled to length 1 in double precision and quantised to int8 with a step of their own; the length of what
quantising loses is kept. For unit vectors x = s*q + e and y likewise, x.y differs from the product of the quantised
vectors by at most |e_x| |s_y q_y| + |s_x q_x| |e_y| + |e_x| |e_y|, so only pairs whose bound reaches the threshold are
computed again in double precision.

Equal vectors of a label are one representative with a count. Representatives are dealt to cells by their angle to a
fixed direction - two vectors as close as the threshold differ by no more than its angle, so only neighbouring cells meet - and cells to blocks
of about `block` rows by a hash. A tile is a pair of blocks; it returns link counts, and of its links only those that join its
components, so no group of pairs is ever listed. Work is that of all tiles that can hold a link; memory is that of two blocks.

Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with nothing.
Vectors of different dimensions don't link. Repeated rows (also of one vec_id) are vectors each; a component's id is the smallest vec_id in it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit vectors as whole numbers from -127 to 127, the step of each row, and the length of its error."""
    step = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / step[:, None]).astype(np.int8)
    return q, step, np.sqrt(((x - q * step[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12


def linked(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs with x[i].y[j] >= least. Products of int8 values are whole numbers under 2**24, so float32 adds them exactly for up to 1,000 dimensions, float64 for more."""
    qx, sx, ex = quantised(x)
    qy, sy, ey = quantised(y)
    kind = np.float32 if x.shape[1] <= 1000 else np.float64
    dot = (qx.astype(kind) @ qy.astype(kind).T).astype(np.float64) * sx[:, None] * sy[None, :]
    nx, ny = 1.0 + ex, 1.0 + ey  # no quantised vector is longer than this
    slack = ex[:, None] * ny[None, :] + nx[:, None] * ey[None, :] + ex[:, None] * ey[None, :]
    i, j = np.nonzero(dot + slack >= least - 1e-12)
    keep = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), 200_000):  # full precision, a bounded number of pairs at a time
        keep[a : a + 200_000] = (x[i[a : a + 200_000]] * y[j[a : a + 200_000]]).sum(axis=1) >= least
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places of links that join different components so far."""
    root, out = list(range(n)), []

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            out.append(k)
    return out


def dedup(vectors: DataFrame, threshold: float = 0.98, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    common.ship(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    biggest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = common.let(biggest, lambda b: F.when(b > 0, F.transform("v", lambda x: x / b)))  # squares neither overflow nor vanish
    length = lambda u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x * x))
    unit = common.let(scaled, lambda u: common.let(length(u), lambda n: F.transform(u, lambda x: x / n)))
    rows = rows.withColumn("v", F.when(fine & (F.size("v") > 0), unit))
    good = rows.where(F.col("v").isNotNull())
    # key: the vector itself, so that equal ones are one
    reps = common.materialize(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("label", "v")))
    angle = math.acos(min(1.0, threshold)) + 1e-6
    # a direction that is fixed for each dimension
    towards = F.aggregate("v", F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, x: F.struct((a["k"] + 1).alias("k"), (a["s"] + x * F.cos(a["k"] * a["k"] + 1.0)).alias("s"), (a["n"] + F.cos(a["k"] * a["k"] + 1.0) * F.cos(a["k"] * a["k"] + 1.0)).alias("n")))
    cells = reps.withColumn("_t", towards).withColumn("cell", F.floor(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("_t.s") / F.sqrt("_t.n")))) / angle).cast("int")).withColumn("dim", F.size("v")).drop("_t")
    sizes = cells.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    sizes = common.materialize(sizes)
    placed = cells.join(sizes.select("label", "dim", "cell", "blocks"), ["label", "dim", "cell"]).withColumn("b", F.pmod(F.col("node"), F.col("blocks")).cast("int"))
    blocks = sizes.select("label", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    # tiles: a block with itself, with later blocks of its cell and with those of the next cell
    other = blocks.select("label", "dim", F.col("cell").alias("cell2"), F.col("b").alias("b2"))
    same = blocks.join(other.withColumn("cell", F.col("cell2")), ["label", "dim", "cell"]).where("b2 >= b")
    following = blocks.join(other.withColumn("cell", F.col("cell2") - 1), ["label", "dim", "cell"])
    tiles = same.unionByName(following).withColumn("tile", F.xxhash64("label", "dim", "cell", "b", "cell2", "b2"))
    ends = tiles.select("label", "dim", "cell", "b", "tile", F.lit(0).alias("side")).unionByName(tiles.where("cell <> cell2 or b <> b2").select("label", "dim", F.col("cell2").alias("cell"), F.col("b2").alias("b"), "tile", F.lit(1).alias("side")))
    members = placed.join(ends, ["label", "dim", "cell", "b"]).select("tile", "side", "node", "copies", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        alone = right.empty
        right = left if alone else right
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        i, j = linked(x, y, threshold)
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        if alone:
            i, j = i[i < j], j[i < j]
        ca, cb = left["copies"].to_numpy(), right["copies"].to_numpy()
        n_left = np.bincount(i, weights=cb[j], minlength=len(a)).astype(np.int64)
        n_right = np.bincount(j, weights=ca[i], minlength=len(b)).astype(np.int64)
        joined = forest(len(a) + len(b), i, j + (0 if alone else len(a)))
        nodes, n = np.concatenate([a, b]), np.concatenate([n_left, n_right])
        out = [pd.DataFrame({"a": nodes[n > 0], "b": nodes[n > 0], "n": n[n > 0]})]
        if joined:
            out.append(pd.DataFrame({"a": a[i[joined]], "b": b[j[joined]], "n": 0}))
        return pd.concat(out)

    found = common.materialize(members.groupBy("tile").applyInPandas(compare, "a long, b long, n long"))
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(found.where("a <> b"))
    least = reps.join(groups, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    known = (
        reps.join(counts, "node", "left").join(groups.join(least, "component").select("node", "component_id"), "node", "left")
        .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    linked_rows = good.join(known, ["label", "v"], "left").select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
