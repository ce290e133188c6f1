"""What the operators share: column checks, the training fold and shipping the package to executors."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, shared_folder  # noqa: F401

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, as a Spark user does with addPyFile.

    Texts may be long, so that Arrow batches of Spark's default of 10,000 rows would fill a worker: they get fewer rows unless the session says otherwise.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.join(name, os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written.

    They stay on the executors' disks until the driver collects its garbage, which a driver with little to do puts off
    (spark.cleaner.periodicGC.interval does the same by the clock). Call it after a large step, not in a loop.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def rows_of(batch, *columns: str) -> Iterator:
    """The values of an Arrow batch, a few hundred rows at a time, so that a batch of long texts isn't held twice."""
    for k in range(0, batch.num_rows, 256):
        part = [batch[c].slice(k, 256).to_pylist() for c in columns]
        yield from part[0] if len(part) == 1 else zip(*part, strict=True)


def packed(text: str) -> bytes:
    """A text for a shuffle, smaller than Spark's own compression of blocks makes it: its length in bytes, then zstd."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(data: bytes) -> str:
    n = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], n, asbytes=True).decode("utf-8", "surrogatepass") if n else ""


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once inside an expression: the optimizer would put it into every turn of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)
