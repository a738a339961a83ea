"""Periodic runs of words, found by bit-parallel lags.

The words of a text become numbers, their bits big integers: plane k holds bit k of every word. For a
lag q the planes are XORed with themselves shifted by q and the results ORed, which marks the words
that differ from the one q further on; repeated AND with itself, shifted by 1, 2, 4, ..., leaves only
places where a stretch of equal words is long enough for a run of period q.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Powers, mix64, range_hashes, returning, text_slices

#: Lags below this are all tried; longer ones only if a sampled window of words recurs at the lag.
FEW = 12
#: Sampled windows that are compared at once; bounds memory, not results.
WINDOWS = 1 << 17


def bit_planes(ids: np.ndarray) -> list[int]:
    """Plane k: an integer whose bit i is bit k of ids[i]."""
    count = int(ids.max(initial=0)).bit_length()
    rows = np.packbits((ids[None, :] >> np.arange(count)[:, None]) & 1, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in rows]


def _places(bits: int) -> np.ndarray:
    data = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(data, bitorder="little"))


def equal_stretches(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """Maximal [first, end) of at least `least` places whose word equals the one `lag` further on."""
    differ = 0
    for plane in planes:
        differ |= plane ^ (plane >> lag)
    same = ~differ & ((1 << (n - lag)) - 1)
    so_far = 1
    while same and so_far < least:
        step = min(so_far, least - so_far)
        same &= same >> step
        so_far += step
    if not same:
        return []
    return list(zip(_places(same & ~(same << 1)).tolist(), (_places(same & ~(same >> 1)) + least).tolist()))


class _Lags:
    """The lags at which a run is possible, in ascending order.

    A run of period q has q or more neighbouring places that equal the one q further on. Of these, some
    window of q - q//2 + 1 places begins at a multiple of q//2, so a lag at which no such window has the
    hash of the one q further on has no run: about 2n/q comparisons a lag, n log n in all. A window
    inside a known run whose period divides q tells of no other: a run of period q around it would have
    that shorter period too. Runs of a period up to half the least lag of a block overlap in less than
    that lag, so each place needs to know one of them only.
    """

    def __init__(self, ids: np.ndarray):
        self.ids = mix64(ids.astype(np.uint64) + np.uint64(1))
        self.n, self.powers = len(ids), Powers()

    def blocks(self, least: int, most: int):
        while least <= most:
            last = min(most, least + max(0, WINDOWS * (least // 2) // self.n))
            yield least, last
            least = last + 1

    def candidates(self, least: int, last: int, runs: list[tuple[int, int, int]]) -> list[int]:
        lags = np.arange(least, last + 1)
        grid = lags // 2
        width = lags - grid + 1
        counts = (self.n - lags - width) // grid + 1
        begins = np.cumsum(counts) - counts
        which = np.repeat(np.arange(len(lags)), counts)
        lag, at = lags[which], (np.arange(len(which)) - begins[which]) * grid[which]
        ends = at + width[which]
        hit = range_hashes(self.ids, at, ends, self.powers) == range_hashes(self.ids, at + lag, ends + lag, self.powers)
        lag, at = lag[hit], at[hit]
        known = [(s, e, p) for s, e, p in runs if 2 * p <= least and e - s > least]
        if known and len(lag):
            inside = np.full(self.n, -1)
            for k, (s, e, _) in enumerate(known):
                inside[s : e - least] = k
            of = inside[at]
            end, period = (np.array([x[k] for x in known])[of] for k in (1, 2))
            told = (of >= 0) & (at + lag < end) & (lag % period == 0)
            lag = lag[~told]
        return np.unique(lag).tolist()


def find_runs(ids: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period.

    A run is a stretch of at least max(least, 2 * period) neighbouring words whose smallest period it
    is and which no neighbouring word extends. Lags are tried in ascending order; a stretch found
    before has a smaller period, which divides this lag.
    """
    n = len(ids)
    if n < least or n < 2:
        return []
    planes, runs, extents = bit_planes(ids), [], set()

    def look(lag: int) -> None:
        need = max(least - lag, lag)
        if lag + need > n:
            return
        for first, end in equal_stretches(planes, n, lag, need):
            if (first, end + lag) not in extents:
                extents.add((first, end + lag))
                runs.append((first, end + lag, lag))

    few = max(FEW, (least + 1) // 2)  # from here on the least stretch is the lag itself
    for lag in range(1, min(few, n // 2 + 1)):
        look(lag)
    if n // 2 >= few:
        lags = _Lags(ids)
        for first, last in lags.blocks(few, n // 2):
            for lag in lags.candidates(first, last, runs):
                look(lag)
    return sorted(((s, e - s, p) for s, e, p in runs), key=lambda run: (run[0], run[2]))


def word_ids(words: list[bytes]) -> np.ndarray:
    index: dict[bytes, int] = {}
    return np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    s, length, p = np.array(runs, np.int64).T
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, s + p, 1)
    np.add.at(steps, s + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def periodic_runs(df: DataFrame, text: str = "text", least: int = 12, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add `runs` (start, length, period; by start, then period) and `collapsed`, the text without repeats.

    Words are maximal stretches without ASCII white space. `collapsed` joins by one space the words that
    no run contains after its first period. One narrow pass over whole texts: no shuffle, and a task
    holds about a megabyte of text at a time, or one longer text. Work is n log n words, plus
    n / 64 * log n for each lag that may hold a run.

    Null and empty texts and texts of fewer than `least` words have no runs (an empty array); a null text
    collapses to the empty one. Repeated rows repeat. An empty table stays empty. Columns of `df` named
    like an output are replaced, all others are kept.
    """
    keep = [c for c in df.columns if c not in (runs, collapsed)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(runs, RUNS, False), T.StructField(collapsed, T.StringType(), False)])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, last, data, offsets in text_slices(column):
                found, left = [], []
                for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                    words = data[a:b].tobytes().split()
                    found.append(find_runs(word_ids(words), least))
                    left.append(b" ".join(without_repeats(words, found[-1])))
                flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
                ends = np.cumsum([0, *map(len, found)])
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])
                arrays = [batch.column(keep.index(c)).slice(first, last - first) for c in keep]
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs))
                arrays.append(pa.array(left, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, [*keep, runs, collapsed])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(returning(run), schema)
