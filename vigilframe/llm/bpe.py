"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pieces (matches of a pattern) are interned per Python worker; pieces not met before are encoded
together: bucketed by length, one padded row each, every row merging its leftmost pair of least rank
once a round. Pair ranks come from an open-addressing hash table over numpy arrays. Rows without a
pair left are compacted away.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from functools import lru_cache
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import returning, text_slices

#: Interned pieces a worker holds before it starts anew; bounds memory, not results.
PIECES = 200_000
#: Pieces longer than this go through a heap of pairs, the same merges in O(n log n).
LONG = 2048
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def narrow_pattern(pattern: str, limit: int = 0x250) -> str:
    """`pattern` with \\p{L} and \\p{N} written out for code points below `limit`, for the standard `re`."""

    def ranges(kind: str) -> str:
        hit = [c for c in range(limit) if unicodedata.category(chr(c))[0] == kind]
        runs = [[k for _, k in g] for _, g in groupby(enumerate(hit), lambda x: x[1] - x[0])]
        return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)

    out, inside, i = [], False, 0
    while i < len(pattern):
        if (m := re.match(r"\\p\{([LN])\}", pattern[i:])) is not None:
            out.append(ranges(m[1]) if inside else f"[{ranges(m[1])}]")
            i += len(m[0])
            continue
        step = 2 if pattern[i] == "\\" else 1
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i : i + step])
        i += step
    return "".join(out)


class PairTable:
    """(left id, right id) -> id of the joined token, which is also its rank; NONE if there is none."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, joined = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(rank)
        self.width = np.int64(max(ranks.values()) + 1)
        keys = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        ids = np.array(joined, np.int32)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slots, rest = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(rest):  # all keys probe at once; one key wins each free slot
            self.probes += 1
            free = self.keys[slots[rest]] == -1
            at, order = np.unique(slots[rest][free], return_index=True)
            won = rest[free][order]
            self.keys[at], self.ids[at] = keys[won], ids[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slots[rest] = (slots[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; negative ids (padding) have none."""
        keys = (left.astype(np.int64) * self.width + right).ravel()
        out = np.full(len(keys), NONE, np.int32)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slot(keys[open_])
        for _ in range(self.probes):
            found = self.keys[slots]
            hit = found == keys[open_]
            out[open_[hit]] = self.ids[slots[hit]]
            go = ~hit & (found != -1)
            if not go.any():
                break
            open_, slots = open_[go], (slots[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        # Below U+0250, but for four controls that `re` takes for white space, both engines agree; `re` is faster.
        self.ranks, self.find, self.find_narrow = ranks, regex.compile(pattern).findall, re.compile(narrow_pattern(pattern)).findall
        self.wide = re.compile("[^\\u0000-\\u001b\\u0020-\\u024f]").search
        self.pairs = PairTable(ranks)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        tokens = {rank: token for token, rank in ranks.items()}
        lengths = np.array([len(tokens.get(i, b"")) for i in range(int(self.pairs.width))], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.vocabulary = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(lengths))), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.offsets, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    # --- encoding of pieces

    def _merge_rows(self, pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Encode pieces of like length, one padded row each: parts of (row numbers, token counts, ids)."""
        sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
        width = int(sizes.max())
        rows = np.full((len(pieces), width), -1, np.int32)
        rows[np.arange(width) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        out = []
        who, ranks = np.arange(len(pieces)), self.pairs(rows[:, :-1], rows[:, 1:])
        while len(who):
            at = ranks.argmin(1)  # argmin takes the leftmost of equals
            live = ranks[np.arange(len(who)), at] < NONE
            if not live.all():
                ended = rows[~live]
                out.append((who[~live], (ended >= 0).sum(1), ended[ended >= 0]))
                who, rows, ranks, at = who[live], rows[live], ranks[live], at[live]
                if not len(who):
                    break
            while (rows[:, -1] < 0).all():
                rows, ranks = rows[:, :-1], ranks[:, :-1]
            width = rows.shape[1]
            each = np.arange(len(rows))
            joined = ranks[each, at]
            stay = np.arange(width - 1) <= at[:, None]  # what stands right of the pair moves one to the left
            moved = np.full_like(rows, -1)
            moved[:, :-1] = np.where(stay, rows[:, :-1], rows[:, 1:])
            moved[each, at] = joined
            shifted = np.full_like(ranks, NONE)
            shifted[:, :-1] = np.where(stay[:, :-1], ranks[:, :-1], ranks[:, 1:])
            rows, ranks = moved, shifted
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs(rows[left, at[left] - 1], joined[left])
            right = np.flatnonzero(at < width - 1)
            ranks[right, at[right]] = self.pairs(joined[right], rows[right, at[right] + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = [int(x) for x in self.bytes[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        first = self.pairs(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and after[i] < n:
                r = int(self.pairs(np.array([ids[i]]), np.array([ids[after[i]]]))[0])
                if r < NONE:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], dead[j], after[i] = rank, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i]), push(i)
        return np.array([x for x, gone in zip(ids, dead) if not gone], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, token counts); a piece that is a token is that token."""
        out, buckets, whole = [], {}, []
        get = self.ranks.get
        for i, piece in enumerate(pieces):
            if (rank := get(piece)) is not None:
                whole.append((i, rank))
            elif (n := len(piece)) > LONG:
                ids = self._merge_long(piece)
                out.append((np.array([i]), np.array([len(ids)]), ids))
            else:
                buckets.setdefault((n + 3) // 4 * 4 if n <= 32 else 1 << (n - 1).bit_length(), []).append(i)
        if whole:
            at = np.array(whole, np.int64)
            out.append((at[:, 0], np.ones(len(at), np.int64), at[:, 1].astype(np.int32)))
        for size, members in buckets.items():
            step = max(16, (1 << 18) // size)
            for k in range(0, len(members), step):
                part = np.array(members[k : k + step])
                out += [(part[rows], counts, ids) for rows, counts, ids in self._merge_rows([pieces[i] for i in part])]
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        who, counts, ids = (np.concatenate([x[k] for x in out]) for k in range(3))
        starts = np.cumsum(counts) - counts
        order = np.argsort(who, kind="stable")
        starts, counts = starts[order], counts[order]
        ends = np.cumsum(counts)
        return ids[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1])], counts

    # --- texts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of the texts)."""
        if len(self.index) > PIECES:
            self._forget()
        found = [(self.find if self.wide(t) else self.find_narrow)(t) if t else [] for t in texts]
        pieces = list(chain.from_iterable(found))
        which = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(which < 0).tolist()):
            index, fresh = self.index, list(dict.fromkeys(pieces[i] for i in new))
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
            ids, counts = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, ids])
            which[new] = np.fromiter((index[pieces[i]] for i in new), np.int64, len(new))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        starts, lengths = self.offsets[which], self.offsets[which + 1] - self.offsets[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.flat[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        return flat, ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts one after the other, offsets of the texts) from encode()'s arrays."""
        starts, lengths = self.starts[ids], self.starts[ids.astype(np.int64) + 1] - self.starts[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.vocabulary[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])], ends[offsets]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(load_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add `ids` (array<int>), the tokens of the whole text, and with `decoded` the bytes they decode to.

    One narrow pass: no shuffle, and no value of a row leaves its task. Null and empty texts have no
    tokens (an empty array, empty bytes). Columns of `df` named like an output are replaced. An empty
    table stays empty. Repeated rows repeat. Characters outside the vocabulary cannot occur: every
    byte is a token.
    """
    keep = [c for c in df.columns if c not in (ids, decoded)]
    fields = [df.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))

    def run(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            column = batch.column(text)
            for first, last, _, _ in text_slices(column):
                flat, offsets = coder.encode([t or "" for t in column.slice(first, last - first).to_pylist()])
                arrays = [batch.column(keep.index(c)).slice(first, last - first) for c in keep]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())))
                if decoded:
                    data, ends = coder.decode(flat, offsets)
                    arrays.append(pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]))
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *([ids, decoded] if decoded else [ids])])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(returning(run), T.StructType(fields))


def lengths(df: DataFrame, path: str, pattern: str, text: str = "text", length: str = "length") -> DataFrame:
    """One column `length`: the number of tokens of each whole text. The tokens themselves stay in the worker."""

    def run(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            column = batch.column(0)
            for first, last, _, _ in text_slices(column):
                _, offsets = coder.encode([t or "" for t in column.slice(first, last - first).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(offsets), pa.int64())], [length])

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(returning(run), f"{length} long")


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add `decoded`, the bytes of the token ids. Null ids decode to empty bytes."""
    keep = [c for c in df.columns if c != decoded]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(decoded, T.BinaryType())])

    def run(batches):
        coder = encoder(path, "")
        for batch in batches:
            column = [np.array(x or [], np.int32) for x in batch.column(ids).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in column])]).astype(np.int64)
            data, ends = coder.decode(np.concatenate([np.zeros(0, np.int32), *column]), offsets)
            out = pa.array([data[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], [*keep, decoded])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
