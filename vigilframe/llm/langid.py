"""Language identification with string kernels.

The kernel of two texts is the normalised number of character n-grams (n = 2 and 3 together, case
folded by single letters, other characters as one break) that both contain. It is approximated from
landmarks (Nystroem); one ridge regression per language against the rest gives the scores, and texts
are scored in batches by two matrix products. N-grams are hashed into fixed presence vectors.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import returning, text_slices

#: Places of the presence vector for 2-grams and for 3-grams.
PLACES = {2: 4096, 3: 8192}
WIDTH = sum(PLACES.values())
#: Training documents per language (about; a hash decides), and languages at most: the documented bound of the sample.
PER_LANGUAGE, LANGUAGES = 400, 200
#: Landmarks in all, and of each language at least; rows of the sample taken at once.
LANDMARKS, OF_EACH, RIDGE, ROWS, AT_ONCE = 160, 4, 0.1, 64, 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def presence(texts: list[str | None], most: int = 1 << 20):
    """Yield (first, last, presence matrix of 0 and 1, has a letter) over runs of at most ROWS whole texts."""
    table, first = _letters(), 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and last - first < ROWS and (last == first or size + len(texts[last] or "") <= most):
            size += len(texts[last] or "")
            last += 1
        part = [t or "" for t in texts[first:last]]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        flat = np.frombuffer((" " + " ".join(part) + " ").encode("utf-32-le", "replace"), np.uint32)
        codes = table[np.minimum(flat, 0x10FFFF)]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)  # runs of other characters are one break
        ends = np.concatenate([[0], np.cumsum(sizes + 1)])
        where = np.flatnonzero(keep)
        codes, rows = codes[where], np.searchsorted(ends[1:], where, "left").clip(0, len(part) - 1)
        found = np.zeros((len(part), WIDTH), bool)
        base = 0
        for n, places in PLACES.items():
            if len(codes) >= n:
                h = np.zeros(len(codes) - n + 1, np.uint32)
                for k in range(n):
                    h = h * np.uint32(0x01000193) + codes[k : len(codes) - n + 1 + k]
                h = ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(places)
                lo, hi = rows[: len(h)], rows[n - 1 :]
                fine = (lo == hi) | (codes[: len(h)] == 0)
                found[hi[fine], base + h[fine]] = True
            base += places
        has = np.bincount(rows[codes != 0], minlength=len(part))[: len(part)] > 0
        yield first, last, found, has
        first = last


def _sliced(column: pa.Array):
    """presence() of a column, about a megabyte of texts at a time."""
    for first, last, _, _ in text_slices(column):
        for a, b, found, has in presence(column.slice(first, last - first).to_pylist()):
            yield first + a, first + b, found, has


class Model:
    """Landmarks and regression weights, fitted on packed presence vectors (bits of rows, one language each).

    Its size is bounded by LANDMARKS, OF_EACH and LANGUAGES; the sample is unpacked AT_ONCE rows at a time
    and only sums over it are kept.
    """

    def __init__(self, packed: np.ndarray, languages: list[str], seed: int = 7):
        self.languages = sorted(set(languages))
        number = {c: i for i, c in enumerate(self.languages)}
        y = np.array([number[x] for x in languages])
        pick = np.random.default_rng(seed)
        order = pick.permutation(len(y))
        nth = np.zeros(len(y), np.int64)
        for c in range(len(self.languages)):
            own = order[y[order] == c]
            nth[own] = np.arange(len(own))
        chosen = order[np.argsort(nth[order], kind="stable")][: max(LANDMARKS, OF_EACH * len(self.languages))]  # languages in turn
        self.marks = self._unpacked(packed[chosen])
        self.norms = np.sqrt(np.maximum(self.marks.sum(1), 1))
        values, basis = np.linalg.eigh(self._kernel(self.marks).astype(np.float64))
        fine = values > 1e-6 * max(values.max(initial=0), 1e-12)
        lift = basis[:, fine] / np.sqrt(values[fine])
        weight = 1 / np.bincount(y, minlength=len(self.languages))[y]  # every language counts alike
        gram = RIDGE / max(1, len(y)) * np.eye(lift.shape[1] + 1)
        aim = np.zeros((lift.shape[1] + 1, len(self.languages)))
        for a in range(0, len(y), AT_ONCE):
            rest = self._kernel(self._unpacked(packed[a : a + AT_ONCE]))
            phi = np.column_stack([rest @ lift, np.ones(len(rest))])
            heavy = phi * weight[a : a + AT_ONCE, None]
            gram += phi.T @ heavy
            aim += heavy.T @ (y[a : a + AT_ONCE, None] == np.arange(len(self.languages)))
        beta = np.linalg.solve(gram, aim)
        self.weights, self.bias = (lift @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32)

    @staticmethod
    def _unpacked(packed: np.ndarray) -> np.ndarray:
        return np.unpackbits(packed, axis=1)[:, :WIDTH].astype(np.float32)

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.marks.T) / np.sqrt(np.maximum(x.sum(1), 1))[:, None] / self.norms

    def __call__(self, found: np.ndarray) -> np.ndarray:
        return self._kernel(found.astype(np.float32)) @ self.weights + self.bias


def in_test_fold(doc_id: str = "doc_id"):
    """Documents that no model learns from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """Fit on a bounded sample of the documents outside the test fold: of each language those whose hashed
    id lies below a threshold, set by the language's count of ids so that about PER_LANGUAGE pass.

    Documents without a language, a text, an id or a letter, and those of the test fold, are not learned
    from; repeated ids count once, by the least presence vector. Of more than LANGUAGES languages the most
    frequent are learned. Counts combine before the shuffle and no language is gathered; presence vectors
    of the sample are made on the executors. None if nothing can be learned.
    """
    labelled = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~in_test_fold("id"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    span = 1 << 40
    chosen = labelled.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("id"), F.lit(span)) < PER_LANGUAGE / F.col("n") * span).select("lang", F.col("id").cast("string").alias("id"), "text")

    def run(batches):
        for batch in batches:
            langs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, found, has in _sliced(batch.column(2)):
                fine = np.flatnonzero(has).tolist()
                packed = np.packbits(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([langs[a + i] for i in fine], pa.string()), pa.array([ids[a + i] for i in fine], pa.string()), pa.array([packed[i].tobytes() for i in fine], pa.binary())], ["lang", "id", "v"])

    once = chosen.mapInArrow(returning(run), "lang string, id string, v binary").groupBy("lang", "id").agg(F.min("v").alias("v"))
    rows = sorted((r["lang"], bytes(r["v"])) for r in once.select("lang", "v").collect())
    if not rows:
        return None
    return Model(np.frombuffer(b"".join(v for _, v in rows), np.uint8).reshape(len(rows), -1), [x for x, _ in rows])


def identify(docs: DataFrame, model: Model | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the language predicted for the whole text and its score (0 to 1).

    Only the text is looked at. Null, empty and letterless texts give `und` with score 0, as does
    everything if nothing was learned. Ties go to the first language by code point. One narrow pass;
    the model is broadcast, its size being fixed. Columns named like an output are replaced.
    """
    keep = [c for c in docs.columns if c not in (lang_pred, score)]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for a, b, found, has in _sliced(batch.column(text)):
                names, scores = np.full(b - a, UNKNOWN, object), np.zeros(b - a)
                if fitted is not None:
                    out = fitted(found)
                    best = out.argmax(1)
                    names[has] = np.array(fitted.languages, object)[best[has]]
                    scores[has] = np.clip(out[np.arange(b - a), best], 0, 1)[has]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), pa.array(names.tolist(), pa.string()), pa.array(scores)], [*keep, lang_pred, score])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(returning(run), schema)
