"""Tokenised documents packed into sequences: best-fit decreasing, certified by dual-feasible functions.

Pieces are dealt by length into partitions that are alike, each packed by best fit, longest first. A dual-feasible
function maps lengths to weights of which no full sequence can hold more than 1, so the weight of a
partition's pieces is a lower bound on its sequences. Partitions above their bound, and the sequence
left open in those that meet it, give their pieces back; these are dealt anew and packed again until
the bound of all that is open certifies it, or nothing is gained.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import returning, written

#: Pieces of one partition in the first round; four times as many in each round that follows, up to MOST_ROWS.
ROWS, MOST_ROWS = 8192, 131072
#: Rows of a range of lengths, from which the partitions are dealt.
RANGE_ROWS = 1 << 14
#: Shuffle partitions of a round; partitions of the packing share them beyond that.
TASKS = 1 << 14
#: Bytes of interned words a worker holds before it starts anew, and what each takes beside its letters; bounds memory, not results.
HELD, WORD_BYTES = 256 << 20, 300
#: Letters that have one form only and one small letter; all ASCII punctuation but the apostrophe.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Bytes as the characters that byte-level vocabularies write them with: printable ones themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = dict(zip([b for b in range(256) if b not in _PRINTABLE], range(256, 512)))
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokens:
    """Ids of texts by a tokenizer that drops white space, which is asked once for each word it meets.

    No token reaches over ASCII white space, nor from an ASCII letter to the punctuation behind it (but
    for an apostrophe), and ASCII capitals count as small letters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the shortcuts below hold if every special token begins with "<"
        self.simple = all(t.content.startswith("<") for t in self.tokenizer.get_added_tokens_decoder().values())
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.known: dict[bytes, bytes] = {b"": b""}
        self.offsets, self.flat, self.held = np.zeros(1, np.int64), np.zeros(0, np.uint32), 0

    def _ask(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        # all letters, or all punctuation, is one unit of the merges; these letters have one form and one small letter
        if word.isalpha() or word and not word.strip(TAIL):
            return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        if LETTERS(text):
            unit = text.lower().encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
            return array("I", [t.id for t in self.model.tokenize(unit)]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, word: bytes) -> bytes:
        """The ids as bytes, which the garbage collector need not visit."""
        core = word.rstrip(TAIL)
        if not self.simple or not core or not (core[-1:].isalpha() or LETTERS(core.decode("utf-8"))) or b"<" in core:
            return array("I", self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids).tobytes()
        tail = word[len(core) :]
        if core.isalpha():
            core = core.lower()
        for part in (core, tail):
            if part not in self.known:
                self.known[part] = self._ask(part)
        return self.known[core] + self.known[tail] if tail else self.known[core]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of the texts)."""
        if self.held > HELD:
            self._forget()
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        index = self.index
        which = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(which < 0).tolist()
        fresh = list(dict.fromkeys(words[i] for i in new))
        if fresh:
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
            ids = [self._ids(w) for w in fresh]
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
            self.held += sum(map(len, fresh)) + WORD_BYTES * len(fresh)
            which[new] = np.fromiter((index[words[i]] for i in new), np.int64, len(new))
        starts, counts = self.offsets[which], self.offsets[which + 1] - self.offsets[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = self.flat[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])]
        return flat, ends[np.cumsum([0, *map(len, split)])]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One for each worker process and vocabulary."""
    return WordTokens(path)


def pieces(df: DataFrame, path: str, capacity: int = 2048, end: int = 0, text: str = "text") -> DataFrame:
    """One row per piece: the other columns of `df`, then piece, start, length and `tokens`.

    A document is the ids of its whole text and `end` behind them. Only documents of more than `capacity`
    ids are cut, into pieces of `capacity`; the last may be shorter. `tokens` are the ids as
    little-endian unsigned 32-bit numbers, ready for a token file. One narrow pass.

    Null and empty texts are `end` alone. Repeated rows repeat. An empty table stays empty. Columns named
    like an output, and the text, are left out.
    """
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("tokens", T.BinaryType())]
    keep = [c for c in df.columns if c != text and c not in [n for n, _ in fields]]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        coder = word_tokens(path)
        for batch in batches:
            column = batch.column(len(keep)).cast(pa.large_binary()).fill_null(b"")
            row, sizes = 0, pc.binary_length(column).to_numpy()
            while row < len(column):
                last = max(row + 1, int(np.searchsorted(np.cumsum(sizes[row:]), 1 << 20, "right")) + row)
                flat, ends = coder.encode(column.slice(row, last - row).to_pylist())
                source, piece, start, length, tokens = [], [], [], [], []
                for k, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                    x = np.append(flat[a:b], np.uint32(end)).astype("<u4")
                    for number, at in enumerate(range(0, len(x), capacity)):
                        part = x[at : at + capacity]
                        source.append(row + k), piece.append(number), start.append(at), length.append(len(part)), tokens.append(part.tobytes())
                taken = [batch.column(i).take(pa.array(source)) for i in range(len(keep))]
                own = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays([*taken, *own], schema.names)
                row = last

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__vf_pack_text")).mapInArrow(returning(run), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length by best-fit decreasing; bins are numbered from 0.

    Open bins lie in stacks by the room they have left, and the bits of `some` say which stacks hold any:
    the lowest set bit from a length on is the tightest fit.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = opened = 0
    order = np.argsort(-lengths, kind="stable")
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                some ^= 1 << room
        else:
            room, at = capacity, opened
            opened += 1
        bins[i], offsets[i] = at, capacity - room
        if room > length:
            stacks[room - length].append(at)
            some |= 1 << (room - length)
    return bins, offsets


@lru_cache(maxsize=4)
def dual_feasible(capacity: int, steps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(weights, denominators): row r gives a length x the weight weights[r, x] / denominators[r].

    Three families: lengths below a threshold count nothing and those above its complement a whole bin;
    lengths rounded down to multiples of 1/k unless (k + 1) times the length is whole; and, for a
    threshold, how many times it is missing from a whole bin, small lengths counting nothing.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    weights, denominators = [], []
    for e in range(0, capacity // 2 + 1):
        weights.append(np.where(x > capacity - e, capacity, np.where(x < e, 0, x)))
        denominators.append(capacity)
    for k in range(1, steps + 1):
        weights.append(np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity))
        denominators.append(capacity * k)
    for e in range(1, capacity // 2 + 1):
        whole = capacity // e
        weights.append(np.where(2 * x > capacity, whole - (capacity - x) // e, np.where(x < e, 0, 1)))
        denominators.append(whole)
    return np.array(weights, np.float64), np.array(denominators, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing of counts[x] pieces of each length x (0 to capacity) has fewer bins. Sums below 2**53 are exact."""
    weights, denominators = dual_feasible(capacity)
    return int((-(-(weights @ counts.astype(np.float64)).astype(np.int64) // denominators)).max())


def pack(items: DataFrame, capacity: int = 2048, length: str = "length", rows: int = ROWS, most_rounds: int = 8) -> DataFrame:
    """Add sequence_id and offset (long): each row's sequence and its place there, gapless from 0.

    No sequence holds more than `capacity`. Rows are sorted by length and a row number and dealt in turn
    into partitions of about `rows`, whatever their ids, so the partitions' bounds add up to little more
    than that of all rows. A partition at its bound keeps all
    sequences but the loosest one; above it, all full ones. What is given back is dealt into larger
    partitions, as long as the bound of all given back leaves room for gain, the last round gained
    something and `most_rounds` (a stop of the search, not of the work) is not reached; a round that
    gains nothing is thrown away. Only a histogram of at most `capacity` lengths and a few sums go to
    the driver; rows carry their columns, so keep them slim.

    Rows of full length are sequences of their own. Null lengths and those below 1 take no place and
    get nulls; a length above `capacity` is an error. Repeated rows are packed each. An empty table
    stays empty. Columns named like an output are replaced; extra columns are kept.
    """
    names, outputs = [c for c in items.columns if c not in ("sequence_id", "offset")], ("sequence_id", "offset")
    size = F.col(f"`{length}`")
    numbered = items.select(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id().alias("__vf_pack_row"))
    checked = F.when(size > capacity, F.raise_error(F.lit(f"a length is above {capacity}"))).otherwise(size).cast("long")
    table, _ = written(numbered.withColumn("__vf_pack_size", checked))
    own, size = [F.col(f"`{c}`") for c in names], F.col("__vf_pack_size")
    nothing = F.lit(None).cast("long")
    done = [
        table.where(size.isNull() | (size < 1)).select(*own, nothing.alias(outputs[0]), nothing.alias(outputs[1])),
        # bit 62 is for these: numbers of rows and of bins do not meet
        table.where(size == capacity).select(*own, (F.col("__vf_pack_row") + F.lit(1 << 62)).alias(outputs[0]), F.lit(0).cast("long").alias(outputs[1])),
    ]
    pool, before, kept_as_is = table.where((size >= 1) & (size < capacity)), None, None
    schema = T.StructType([*pool.schema.fields, *(T.StructField(f"__vf_pack_{c}", T.LongType()) for c in ("part", "bin", "at", "open"))])

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["__vf_pack_size"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        filled = np.bincount(bins, lengths).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        loose = filled < capacity
        if len(filled) == bound:  # certified: only its loosest sequence may still take others
            loose &= np.arange(len(filled)) == filled.argmin()
        return frame.assign(__vf_pack_bin=bins, __vf_pack_at=offsets, __vf_pack_open=loose[bins].astype(np.int64))

    for turn in range(most_rounds):
        counts = np.zeros(capacity + 1, np.int64)
        for x, n in pool.groupBy(size).count().collect():
            counts[x] = n
        if not counts.any() or before is not None and lower_bound(counts, capacity) >= before:
            break
        parts = max(1, -(-int(counts.sum()) // min(rows * 4**turn, MOST_ROWS)))
        # like cards: sorted by length, dealt in turn, so each partition has its share of every length
        ranges = min(TASKS, -(-int(counts.sum()) // RANGE_ROWS))
        ranked = pool.repartitionByRange(ranges, size, "__vf_pack_row").sortWithinPartitions(size, "__vf_pack_row")
        nth = F.monotonically_increasing_id()  # the range in the high bits, the place in it in the low 33
        first = F.xxhash64(F.shiftright(nth, 33), F.lit(turn))
        dealt = ranked.withColumn("__vf_pack_part", F.pmod(first + nth.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(parts)))
        dealt = dealt.repartition(min(parts, TASKS), "__vf_pack_part")
        now, _ = written(dealt.groupBy("__vf_pack_part").applyInPandas(packed, schema))
        key = F.struct("__vf_pack_part", "__vf_pack_bin")
        starts = now.where("__vf_pack_at = 0")  # one row for each sequence
        total, still = starts.agg(F.count("*"), F.sum("__vf_pack_open")).first()
        if before is not None and total >= before:
            break
        number = F.lit((turn + 1) << 56) + F.shiftleft("__vf_pack_part", 24) + F.col("__vf_pack_bin")
        now = now.withColumn("__vf_pack_id", number)
        done.append(now.where("__vf_pack_open = 0").select(*own, F.col("__vf_pack_id").alias(outputs[0]), F.col("__vf_pack_at").alias(outputs[1])))
        kept_as_is = now.where("__vf_pack_open = 1").select(*own, F.col("__vf_pack_id").alias(outputs[0]), F.col("__vf_pack_at").alias(outputs[1]))
        pool, before = now.where("__vf_pack_open = 1").select(*table.columns), still
        if not still:
            break
    if kept_as_is is not None:
        done.append(kept_as_is)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
