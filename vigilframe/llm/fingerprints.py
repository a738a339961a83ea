"""Context-triggered piecewise hashes of documents and their likeness.

A rolling hash over the last seven bytes cuts a text wherever it meets the block size; each chunk
gives one character of the signature. Block sizes are 3 * 2**k; a fingerprint holds the signatures at
k and k + 1 ("blocksize:signature:signature"), so two fingerprints compare at equal or neighbouring
block sizes. Everything is computed over flat byte arrays, not byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Powers, mix64, range_hashes

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WINDOW, LONGEST, LEVELS = 7, 64, 40
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = Powers()


def fingerprints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text; equal texts give equal fingerprints, an empty one `3::`."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = b"\0" * WINDOW
    flat = np.frombuffer(pad + pad.join(texts), np.uint8)
    ends = np.cumsum(sizes + WINDOW)
    starts = ends - sizes
    wide = flat.astype(np.uint32)
    plain, weighted, shifted = (np.zeros(len(flat), np.uint32) for _ in range(3))
    for back in range(WINDOW):
        seen = wide[: len(flat) - back]
        plain[back:] += seen
        weighted[back:] += seen * np.uint32(WINDOW - back)
        shifted[back:] ^= seen << np.uint32(5 * back)
    rolled = plain + weighted + shifted + np.uint32(1)
    hits = np.flatnonzero(rolled % np.uint32(3) == 0)
    owner = np.searchsorted(ends, hits, "right")
    inside = (owner < len(texts)) & (hits >= starts[np.minimum(owner, len(texts) - 1)])
    hits, owner = hits[inside], owner[inside]
    value = rolled[hits].astype(np.int64)
    value[value == 0] = 1 << 32
    level = np.log2((value & -value).astype(np.float64)).astype(np.int64)
    counts = np.bincount(owner * LEVELS + level, minlength=len(texts) * LEVELS).reshape(-1, LEVELS)
    reach = counts[:, ::-1].cumsum(1)[:, ::-1]  # triggers at block size 3 * 2**k
    k = np.ceil(np.log2(np.maximum(sizes, 1) / (3 * LONGEST))).clip(0, LEVELS - 2).astype(np.int64)
    while (short := (k > 0) & (reach[np.arange(len(texts)), k] < LONGEST // 2)).any():
        k[short] -= 1
    values = _BYTE[flat]

    def signatures(least: np.ndarray, most: int) -> list[bytes]:
        cut = level >= least[owner]
        who, at = owner[cut], hits[cut] + 1
        nth = np.arange(len(who)) - np.searchsorted(who, who)  # chunks beyond the last place join the last
        who, at = who[nth < most - 1], at[nth < most - 1]
        here = np.arange(len(texts))
        tail = np.ones(len(texts), bool)
        if len(who):
            last = np.searchsorted(who, here, "right") - 1
            full = (last >= 0) & (who[np.maximum(last, 0)] == here)
            tail = ~(full & (at[np.maximum(last, 0)] == ends))
        tail &= sizes > 0
        all_who, all_end = np.concatenate([who, here[tail]]), np.concatenate([at, ends[tail]])
        order = np.lexsort((all_end, all_who))
        all_who, all_end = all_who[order], all_end[order]
        begin = np.where(np.concatenate([[True], all_who[1:] != all_who[:-1]]) if len(all_who) else np.zeros(0, bool), starts[all_who], np.concatenate([[0], all_end[:-1]])[: len(all_end)])
        letters = ALPHABET[(range_hashes(values, begin, all_end, _POWERS) >> np.uint64(58)).astype(np.int64)].tobytes()
        edges = np.searchsorted(all_who, np.arange(len(texts) + 1))
        return [letters[a:b] for a, b in zip(edges, edges[1:])]

    one, two = signatures(k, LONGEST), signatures(k + 1, LONGEST // 2)
    return [f"{3 << int(n)}:{a.decode()}:{b.decode()}" for n, a, b in zip(k, one, two)]


def _matrix(signs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, signs), np.int64, len(signs))
    out = np.zeros((len(signs), max(1, int(sizes.max(initial=0)))), np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(signs).encode(), np.uint8)
    return out, sizes


def _signature_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 - edits / (both lengths), an insertion or deletion being one edit and a change two.

    Signatures without a common run of four characters (half the shorter, if less) count 0.
    """
    a, n = _matrix(left)
    b, m = _matrix(right)
    rows = np.arange(len(left))
    steps = np.arange(b.shape[1] + 1, dtype=np.int16)
    line = np.repeat(steps[None], len(left), 0)
    runs, longest = np.zeros_like(line), np.zeros(len(left), np.int16)
    edits = m.astype(np.int16)
    for i in range(a.shape[1]):
        same = (a[:, i, None] == b) & (a[:, i, None] != 0)
        new = np.empty_like(line)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(line[:, 1:] + np.int16(1), line[:, :-1] + np.where(same, np.int16(0), np.int16(2)))
        line = np.minimum.accumulate(new - steps, axis=1) + steps
        grown = np.zeros_like(runs)
        grown[:, 1:] = np.where(same, runs[:, :-1] + np.int16(1), np.int16(0))
        runs = grown
        longest = np.maximum(longest, runs.max(1))
        done = n == i + 1
        edits[done] = line[rows[done], m[done]]
    total = n + m
    like = 1 - edits / np.maximum(total, 1)
    need = np.minimum(4, np.maximum(1, np.minimum(n, m) // 2))
    like[longest < need] = 0
    like[total == 0] = 1
    return np.clip(like, 0, 1)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of fingerprints in [0, 1]: 1 if equal, 0 at block sizes more than a doubling apart."""
    out = np.zeros(len(left))
    pairs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[i] = 1
            continue
        (p, a1, a2), (q, b1, b2) = x.split(":"), y.split(":")
        if p == q:
            pairs += [(i, a1, b1), (i, a2, b2)]
        elif int(p) == 2 * int(q):
            pairs.append((i, a1, b2))
        elif int(q) == 2 * int(p):
            pairs.append((i, a2, b1))
    pairs = [x for x in pairs if x[1] and x[2]]
    for k in range(0, len(pairs), 2048):
        who, a, b = zip(*pairs[k : k + 2048])
        np.maximum.at(out, np.array(who), _signature_likeness(list(a), list(b)))
    return out


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_successors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Per document its fingerprint, that of an edited text, and likenesses to it and to the next document.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next
    document by ascending id (after the last: of the first). Documents travel once, into key ranges
    whose bounds are ids that occur; the first document of a range travels to the range before it
    too, so each range is a sorted stream that needs no other. `ranges` changes no result.

    Null text counts as empty. A null id sorts first; equal ids are ordered by text. A single row is
    its own successor. An empty table gives none. Other columns are not read.
    """
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])
    spark = docs.sparkSession
    ranges = ranges or min(10_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array().cast("array<double>")
    edges = rows.agg(F.min("id").alias("low"), F.percentile_approx("id", shares, 10 * ranges).alias("cuts") if ranges > 1 else F.lit(None).alias("cuts"), F.max(F.col("id").isNull()).alias("nulls")).first()
    low = None if edges["nulls"] else edges["low"]
    cuts = sorted({x for x in edges["cuts"] or [] if edges["low"] is not None and (low is None or x > low)})
    at = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(x) for x in cuts])  # binary search: the number of bounds not above the id
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
        at = F.aggregate(steps, F.lit(0), lambda found, s: F.when(F.get(bounds, found + s - 1) <= F.col("id"), found + s).otherwise(found))
    first_of = {None if low is None else low: len(cuts)} | {c: i for i, c in enumerate(cuts)}  # id -> the range that it follows
    keys = [x for x in first_of if x is not None]
    follows = F.when(F.col("id").isNull(), F.lit(first_of.get(None)).cast("int"))
    if keys:
        follows = follows.when(F.col("id").isin(keys), F.when(F.col("id") == F.lit(low), F.lit(len(cuts))).otherwise(F.col("at") - 1) if low is not None else F.col("at") - 1)
    placed = (
        rows.withColumn("at", at)
        .withColumn("after", follows)
        .select("id", "text", F.explode(F.when(F.col("after").isNull(), F.array(F.struct("at", F.lit(0).alias("extra")))).otherwise(F.array(F.struct("at", F.lit(0).alias("extra")), F.struct(F.col("after").alias("at"), F.lit(1).alias("extra"))))).alias("p"))
        .select("p.at", "p.extra", "id", "text")
        .repartition("at")
        .sortWithinPartitions("at", "extra", F.col("id").asc_nulls_first(), "text")
    )

    def emit(ready: list[tuple]) -> pa.RecordBatch:
        ids, texts, following = zip(*ready)
        edited = [_edited(t, f) for t, f in zip(texts, following)]
        as_bytes = [[x.encode("utf-8", "surrogatepass") for x in col] for col in (texts, edited, following)]
        own, other = fingerprints(as_bytes[0]), fingerprints(as_bytes[1])
        after = own[1:] + fingerprints(as_bytes[2][-1:]) if following[:-1] == texts[1:] else fingerprints(as_bytes[2])
        digests = [hashlib.sha256(x).hexdigest() for x in as_bytes[1]]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(digests, pa.string()), pa.array(own, pa.string()), pa.array(other, pa.string()), pa.array(likeness(own, other)), pa.array(likeness(own, after))],
            names=[f.name for f in schema.fields],
        )

    def run(batches):
        held, ready, waiting = None, [], 0
        for batch in batches:
            for at_, extra, id_, text_ in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held is not None and held[0] == at_:
                    ready.append((held[1], held[2], text_))
                    waiting += len(held[2])
                held = None if extra else (at_, id_, text_)
                if waiting > 1 << 20 or len(ready) >= 1000:
                    yield emit(ready)
                    ready, waiting = [], 0
        if ready:
            yield emit(ready)

    return placed.mapInArrow(run, schema)
