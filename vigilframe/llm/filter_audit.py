"""How filters of a corpus interact, in every order: packed bitmaps, AND-NOT and popcount.

Each document is a bit in the bitsets of the filters that it fails, of its labels and of its part. What a
filter removes after others depends only on the set of those before it, so five filters in 120 orders
need 32 sets and 80 pairs of a set and a next filter.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import returning, written

FILTERS = "ABCDE"
#: Documents and parts of one bitmap at most; bounds memory, not results.
BITS, PARTS = 1 << 16, 64
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"


def fails(data: bytes) -> int:
    """Bits 0 to 3: under 200 words; few distinct words; many capitals; holds one of #$%&*|."""
    words = data.split()  # of bytes: splits at ASCII white space only
    capitals = len(data) - len(data.translate(None, CAPITALS))
    code_points = len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 3 * code_points) << 2
        | (len(data.translate(None, SIGNS)) < len(data)) << 3
    )


def text_failures(df: DataFrame, text: str = "text") -> DataFrame:
    """Every column but the text, with `digest` (128 bits of the whole text's BLAKE2b) and `fails` (A to D). One narrow pass."""
    keep = [c for c in df.columns if c not in (text, "digest", "fails")]
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + "digest binary, fails int"

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary()).fill_null(b"")
            digests, found = [], []
            for t in texts:
                data = t.as_py()
                digests.append(hashlib.blake2b(data, digest_size=16).digest())
                found.append(fails(data))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(digests, pa.binary()), pa.array(found, pa.int32())], [*keep, "digest", "fails"])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__vf_audit_text")).mapInArrow(returning(run), schema)


def with_copies(docs: DataFrame) -> DataFrame:
    """`fails` with bit 4 for each document whose digest a smaller doc_id has too.

    The least id of a digest is an aggregate that combines before the shuffle; only digests that
    occur under several ids are joined back, by a join that adaptive execution may split.
    """
    least = docs.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    joined = docs.join(least, "digest", "left")
    return joined.select("doc_id", "part", (F.col("fails") + F.when(F.col("doc_id") > F.col("least"), F.lit(16)).otherwise(F.lit(0))).alias("fails"))


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits): bits 0 to 4 of `fails`, 5 for quality 1 and 6 for toxic 1 in any label row of the id."""
    found = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    marked = docs.join(found, "doc_id", "left")
    return marked.select("part", (F.col("fails") + 32 * F.coalesce("good", F.lit(0)) + 64 * F.coalesce("bad", F.lit(0))).cast("int").alias("bits"))


def _popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(-1, dtype=np.int64)


def _subset_counts(sets: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Counts of every part (rows of `parts`, bitsets) from bitsets A to E, good, toxic.

    Shape (parts, 80, 6): for a set of filters and a next one, in the order of `steps()`: kept, removed,
    redundant, unique, good and toxic among the removed.
    """
    bad, (good, toxic) = sets[:5], sets[5:]
    out = np.zeros((len(parts), 80, 6), np.int64)
    for k, (before, nth) in enumerate(steps()):
        dead = np.bitwise_or.reduce(bad[[j for j in range(5) if before >> j & 1]], axis=0) if before else np.zeros_like(good)
        failing = parts & bad[nth]
        removed = failing & ~dead
        others = np.bitwise_or.reduce(bad[[j for j in range(5) if j != nth]], axis=0)
        counted = (parts & ~(dead | bad[nth]), removed, failing & dead, failing & ~others, removed & good, removed & toxic)
        for c, bits in enumerate(counted):
            out[:, k, c] = _popcount(bits)
    return out


def steps() -> list[tuple[int, int]]:
    """(set of filters before, next filter): all 80 of five filters."""
    return [(before, nth) for before in range(32) for nth in range(5) if not before >> nth & 1]


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def bitmap_counts(marked: DataFrame) -> DataFrame:
    """(part, before, nth, counts): sums over bitmaps of at most BITS documents and PARTS parts each.

    A task sends 80 rows for each bitmap and part, whatever its documents.
    """

    def run(batches):
        numbers = steps()
        for batch in batches:
            names, which = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            bits = batch.column(1).to_numpy()
            order = np.argsort(which, kind="stable")
            which, bits = which[order], bits[order]
            first = 0
            while first < len(which):
                last = min(first + BITS, int(np.searchsorted(which, which[first] + PARTS)))
                own, local = bits[first:last], which[first:last] - which[first]
                width = -(-len(own) // 64) * 64
                rows = np.zeros((7, width), bool)
                rows[:, : len(own)] = (own[None, :] >> np.arange(7)[:, None]) & 1
                parts = np.zeros((int(local[-1]) + 1, width), bool)
                parts[local, np.arange(len(own))] = True
                counts = _subset_counts(*(np.packbits(x, axis=1).view(np.uint64) for x in (rows, parts)))
                n = len(parts) * 80
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names[which[first] : which[first] + len(parts)], 80), pa.string())]
                    + [pa.array(np.tile([s[k] for s in numbers], len(parts)), pa.int32()) for k in range(2)]
                    + [pa.array(counts.reshape(n, 6)[:, c]) for c in range(6)],
                    ["part", "before", "nth", *COUNTS],
                )
                first = last

    partial = marked.mapInArrow(run, "part string, before int, nth int, " + ", ".join(f"{c} long" for c in COUNTS))
    return partial.groupBy("part", "before", "nth").agg(*[F.sum(c).alias(c) for c in COUNTS])


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: Column | None = None) -> DataFrame:
    """One row for each part, order of the five filters and step: see the names in COUNTS, and shapley.

    `part` is an expression over `docs` (default: lang, null as the empty string). Texts are read once;
    what is written and shuffled afterwards is an id, a digest and a part for each document. Parts are
    counted apart, in bitmaps that are cut by parts, so any number of parts is fine.

    shapley: what the filter removes, summed over all orders. A set of k filters stands before it in
    k! (4 - k)! orders.

    Null texts are empty texts, and equal to these. A null id is no copy of another and has no labels;
    ids that repeat are rows of their own, and a copy needs a smaller id, not an earlier row. Several
    label rows of an id count as one that has any of their marks; null marks are no marks. An empty table
    gives no rows. Extra columns are not read.
    """
    of = F.coalesce(F.col("lang"), F.lit("")) if part is None else part
    slim, _ = written(text_failures(docs.select(F.col(doc_id).alias("doc_id"), of.alias("part"), F.col(text).alias("text"))))
    counts = bitmap_counts(with_labels(with_copies(slim), labels.select("doc_id", "quality", "toxic")))
    spark = docs.sparkSession
    every = []
    for order in permutations(range(5)):
        name = "".join(FILTERS[k] for k in order)
        every += [(name, step + 1, sum(1 << j for j in order[:step]), nth) for step, nth in enumerate(order)]
    orders = spark.createDataFrame(every, "filter_order string, step int, before int, nth int")  # 600 rows
    times = [factorial(k) * factorial(4 - k) for k in range(5)]
    weight = F.get(F.array(*[F.lit(t) for t in times]), F.bit_count("before"))
    shapley = counts.groupBy("part", "nth").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    return counts.join(F.broadcast(orders), ["before", "nth"]).join(shapley, ["part", "nth"]).select("part", "filter_order", "step", *COUNTS, "shapley")
