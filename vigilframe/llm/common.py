"""What several corpus operators share: durable intermediates, Arrow text buffers, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import checkpoint_folder, durable  # noqa: F401 - operators take it from here

#: Up to this many bytes (measured, not estimated) a side may be broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """`df` read back from a table written beside the checkpoints, and a function that removes the table.

    For large steps: a checkpoint stays until the driver ends, and so does the table unless it is removed,
    which it can be as soon as the next step is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)

    def remove() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), remove


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files and checkpoints of earlier steps that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which may otherwise come long after a step.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its counted rows fit `limit` bytes, else as it is (shuffle join)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def text_slices(column: pa.Array, most: int = 1 << 20):
    """Yield (first row, last row + 1, bytes, offsets) of a string column, about `most` bytes at a time.

    Null counts as empty. A text longer than `most` comes alone and whole.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def returning(run):
    """`run` over batches, giving the memory that it freed back to the machine at its end.

    Python workers live on between tasks, several on one executor, and allocators keep what large
    arrays left.
    """

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """B**i and its inverse modulo 2**64, grown on demand, for hashes of ranges by prefix sums."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of values[starts[i]:ends[i]] for every i, independent of where the range lies."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, component), the component being its least node.

    Large-star and small-star rounds until nothing changes. Minima are aggregates joined back, so a
    node with very many edges is pre-aggregated and its join can be split. Rounds are checkpointed;
    only the count of changes goes to the driver.
    """
    pairs = durable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u > v").distinct()
    )
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = durable(small.where("u > v").distinct())
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v"), F.col("v"))).distinct()
