"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Candidates and queries are dealt into blocks of bounded size; every pair of blocks is one group. In
a group each dimension is a posting list (rows with a weight there); the queries' weights for it are
scattered, multiplied, into a dense score array. Each block keeps its best k by partition selection,
and a window over the kept rows merges the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block at most (about 16 MB of 64 dimensions each), and of the
#: smallest candidate block worth a task: a small table is dealt over the machines that there are.
BLOCK, QUERIES, LEAST = 32768, 32768, 4096


def quantised(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) per component; rows null, or with null or non-finite components, drop."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.where(e.isNotNull() & F.col(vec_id).isNotNull() & fine).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v")
    )


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors; a vector shorter than the others has zeros at its end."""
    ids = table.column("vec_id").to_numpy()
    column = table.column("v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def accumulate(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores [candidate, query] term at a time, in the narrowest integers that hold every partial sum."""
    dims = min(candidates.shape[1], queries.shape[1])
    bound = float(np.sqrt((candidates.astype(float) ** 2).sum(1).max(initial=0)) * np.sqrt((queries.astype(float) ** 2).sum(1).max(initial=0)))
    kind = np.int16 if bound < 2**15 - 2 else np.int32 if bound < 2**31 - 2 else np.int64
    candidates, queries = candidates.astype(kind), queries.astype(kind)
    scores = np.zeros((len(candidates), len(queries)), kind)
    step = max(1, (1 << 17) // max(1, len(queries)))  # rows at once, so that they stay in the cache
    for first in range(0, len(candidates), step):
        part, held = candidates[first : first + step], scores[first : first + step]
        for t in range(dims):
            postings = np.flatnonzero(part[:, t])
            if len(postings) == len(part):
                held += part[:, t, None] * queries[:, t]
            elif len(postings):
                held[postings] += part[postings, t, None] * queries[:, t]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of one query's scores, ties to the smaller id; `ids` ascend; the query's own id is left out."""
    lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    if hi > lo:
        scores, ids = np.delete(scores, slice(lo, hi)), np.delete(ids, slice(lo, hi))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        pick = np.concatenate([above, equal[: k - len(above)]])
    else:
        pick = np.arange(len(scores))
    return ids[pick], scores[pick]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all other rows.

    Components count as floor(scale * x). Vectors that are null or hold a null or non-finite component,
    and rows without an id, take no part. Ties go to the smaller id. A query with fewer other rows gets
    all of them; alone, none. Repeated ids: all rows of the query's id count as its own; other repeated
    rows each count as candidates, repeated queries (id and vector) ask once. Vectors of different length
    multiply over the components both have. Scores must fit 64 bits. Other columns are not read.

    Repeated candidates are counted first and travel as often as a result could hold them, k times. Rows
    are dealt by a hash of id, vector and copy, so a rerun deals alike, and equal vectors form no group
    of their own; blocks hold about BLOCK and QUERIES rows at most. Nothing is broadcast.
    """
    c, q = quantised(candidates, vec_id, embedding, scale), quantised(queries, vec_id, embedding, scale).distinct()
    rows = candidates.count()
    n_c = max(1, -(-rows // BLOCK), min(-(-rows // LEAST), candidates.sparkSession.sparkContext.defaultParallelism))
    n_q = max(1, -(-queries.count() // QUERIES))
    c = c.groupBy("vec_id", "v").agg(F.count("*").alias("rows")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("rows", F.lit(k)).cast("int"))))
    c = c.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v", "copy"), F.lit(n_c)).cast("int")).select("vec_id", "v", "cb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    q = q.withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_q)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            ids, vectors = _matrix(left)
            asked, wanted = _matrix(right)
            for first in range(0, len(asked), 256):
                scores = np.ascontiguousarray(accumulate(vectors, wanted[first : first + 256]).T)
                for own, line in zip(asked[first : first + 256], scores):
                    found, values = best(line, ids, own, k)
                    out.append((np.full(len(found), own), found, values.astype(np.int64)))
        columns = [np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)]) for i in range(3)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    kept = c.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInArrow(pair, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
