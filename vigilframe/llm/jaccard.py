"""N-gram Jaccard join with several global token orders.

Two word-shingle sets with Jaccard similarity of at least t/100 must share tokens in the prefixes of
both sets under every total order of tokens. A pair is a candidate only if it does so under all of

1. tokens by hash, ascending: an extended prefix, of which several tokens must occur in other sets,
   first leaves out most sets; later every pair must share one of its own prefix;
2. rare tokens first: the posting lists of these prefixes bring pairs together;
3. tokens by hash, descending.

Pairs of lists of at most LIST sets are told one by one and verified by joins. Sets of longer lists
(families of near copies) form clusters, which are verified in tiles of two parts of near sizes by
matrix products, so that a family's pairs are counted but never written.

Equal sets are one class throughout, known by a 128-bit digest of the set and numbered once. Shingles
are known by 64-bit hashes. Verification is by exact intersection sizes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, Powers, components, durable, give_back, mix64, range_hashes, release, returning, small_side, text_slices, written

#: Classes of one side of a tile; a larger cluster is dealt over pairs of such parts. Classes of the longest
#: posting list whose pairs are told one by one.
PART, LIST = 512, 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = Powers()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Ascending distinct hashes of the n-word shingles of each text of a flat byte array.

    Fewer than n words make one shingle of the whole sequence, no words none.
    """
    data = _LOWER[data]
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | edge))
    ends = np.flatnonzero(before & (~word | edge))
    words = range_hashes(_BYTE[data], starts, ends, _POWERS)
    first = np.searchsorted(starts, offsets)  # the first word of each text
    out = []
    m = max(0, len(words) - n + 1)
    grams = np.zeros(m, np.uint64)
    for k in range(n):
        grams = mix64(grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m])
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                whole = mix64(whole * np.uint64(0xC2B2AE3D27D4EB4F) + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, text: str, keep: list[str], n: int, prefix) -> DataFrame:
    """keep columns, k (class of the set, null if empty), n_shingles, tokens (the first prefix(size) of the set)."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("k", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(text)):
                sets = shingle_sets(data, offsets, n)
                kept = [s[: prefix(len(s))].view(np.int64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in kept])])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(a, b - a) for c in keep),
                        pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *kept]), pa.int64())),
                    ],
                    [*keep, "k", "n_shingles", "tokens"],
                )

    return docs.select(*keep, text).mapInArrow(returning(run), schema)


def _prefix_products(sets: list[np.ndarray], sizes: np.ndarray, spare: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether two sets share a prefix token under `order` (a rank per token): a boolean matrix."""
    picked = [s[np.argsort(order[s], kind="stable")[: k + 1]] for s, k in zip(sets, spare)]
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in picked])
    tokens, columns = np.unique(np.concatenate(picked), return_inverse=True)
    shared = np.bincount(columns, minlength=len(tokens)) > 1
    number = np.cumsum(shared) - 1
    fine = shared[columns]
    rows, columns = rows[fine], number[columns[fine]]
    out = np.zeros((len(sets), len(sets)), bool)
    for first in range(0, int(shared.sum()), 4096):
        here = (columns >= first) & (columns < first + 4096)
        m = np.zeros((len(sets), min(4096, int(shared.sum()) - first)), np.float32)
        m[rows[here], columns[here] - first] = 1
        out |= (m @ m.T) > 0
    return out


def tile_links(sides: np.ndarray, token_lists: list[np.ndarray], t: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (positions) of the sets of one tile, or those across its two sides only."""
    sizes = np.array([len(x) for x in token_lists], np.int64)
    flat = np.concatenate(token_lists)
    vocabulary, inverse = np.unique(flat, return_inverse=True)
    counts = np.bincount(inverse)
    sets = np.split(inverse, np.cumsum(sizes)[:-1])
    spare = sizes - -(-sizes * t // 100)
    by_hash, total = np.arange(len(vocabulary)), len(vocabulary) + 1
    wanted = np.triu(np.ones((len(sides), len(sides)), bool), 1)
    wanted &= (100 * sizes[:, None] >= t * sizes) & (100 * sizes >= t * sizes[:, None])
    if across:
        wanted &= sides[:, None] != sides
    for ranks in (counts * total + by_hash, by_hash, -by_hash):
        if not wanted.any():
            break
        wanted &= _prefix_products(sets, sizes, spare, ranks)
    left, right = np.nonzero(wanted)
    if not len(left):
        return left, right
    shared = np.zeros(len(left), np.int64)
    if len(left) <= 4 * len(sides):
        for i, (a, b) in enumerate(zip(left, right)):
            shared[i] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:
        common = counts > 1
        number, used = np.cumsum(common) - 1, int(common.sum())
        rows = np.repeat(np.arange(len(sets)), sizes)
        fine = common[inverse]
        rows, columns = rows[fine], number[inverse[fine]]
        for first in range(0, used, 4096):
            here = (columns >= first) & (columns < first + 4096)
            m = np.zeros((len(sets), min(4096, used - first)), np.float32)
            m[rows[here], columns[here] - first] = 1
            shared += (m @ m.T)[left, right].astype(np.int64)
    linked = 100 * shared >= t * (sizes[left] + sizes[right] - shared)
    return left[linked], right[linked]


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the given pairs connect, fewer than n."""
    parent, out = list(range(n)), []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = a, b
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def similarity_components(docs: DataFrame, n: int = 3, t: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links, its own included), n_links.

    Rows link when their sets of n-word shingles (A-Z lower-cased, words between ASCII white space) have
    100 * intersection >= t * union; n_links counts a row's links to other rows. Texts of fewer than n
    words are one shingle; texts without words and null texts are empty sets, linked with nothing.
    A null id is not a least id: a component of null ids only has a null component_id. Repeated rows
    and ids are rows of their own; a row with its id equal to another's is still one row. An empty
    table gives none. Other columns are not read.

    Texts are read twice and never shuffled unless the classes that order 1 leaves outgrow a broadcast.
    Prefix tokens are counted by pre-aggregating joins, so a token of many documents is split like any
    skewed join key. Clusters are dealt into tiles of at most two parts of about PART classes.
    """
    first, of_class = _linked(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), n, t, ["doc_id"])
    return first.where("k is not null").select("doc_id", "k", "n_shingles").join(of_class, "k").select("doc_id", "n_shingles", "component_id", "n_links").union(
        first.where("k is null").select("doc_id", "n_shingles", "doc_id", F.lit(0).cast("long"))
    )


def _linked(docs: DataFrame, n: int, t: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of doc_id and text: (keep columns, k and n_shingles per row; k, component, component_id and n_links per class)."""
    share = lambda x: x - -(-x * t // 100)  # noqa: E731  tokens that may be missing from a partner
    extra = lambda x: share(x) // 2 + 1  # noqa: E731  tokens that partners of at least x tokens share in their prefixes
    spare = lambda size: size - F.ceil(size * t / 100)  # noqa: E731  share() as a column
    sets, remove_sets = written(_sets(docs, "text", keep, n, lambda x: share(x) + extra(x)))
    grouped = sets.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"), F.max("n_shingles").alias("size"), F.first("tokens").alias("tokens"))
    # numbers are drawn once, as they are written: what follows reads them and never draws again
    numbered, remove_numbered = written(grouped.withColumn("c", F.monotonically_increasing_id()))
    first = durable(sets.drop("tokens"))
    remove_sets()
    release(first)

    # order 1: of the extended prefix, as many tokens as the smallest partner could share must occur elsewhere
    spread = numbered.select("c", F.explode("tokens").alias("token"))
    common, remove_common = written(spread.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"))
    release(common)
    classes = durable(numbered.drop("tokens"))
    least = F.ceil(F.col("size") * t / 100)
    need = F.floor((least - F.ceil(least * t / 100)) / 2) + 1
    viable = spread.join(common, "token", "left_semi").groupBy("c").agg(F.count("*").alias("shared")).join(classes, "c")
    viable = durable(viable.where(F.col("shared") >= need).select("c", "k", "least", "members"))
    remove_common(), remove_numbered()
    release(viable)

    # their whole sets, from the text of one row of each class
    wanted = viable.select(F.col("least").alias("doc_id"))
    wanted = small_side(wanted, 16, BROADCAST_BYTES)
    picked = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    full = _sets(picked, "text", ["doc_id"], n, lambda x: x).where("k is not null").groupBy("k").agg(F.first("tokens").alias("tokens"))
    whole, remove_whole = written(full.join(viable, "k").select("c", F.size("tokens").cast("long").alias("n_shingles"), "members", "tokens"))
    release(whole)

    # order 2: rare tokens first; tokens of one class only come before all others, so they fill a prefix first
    places = spare(F.col("n_shingles")) + 1 - F.col("n_shingles")  # plus the shared tokens
    occurring = whole.select("c", F.explode("tokens").alias("token"))
    counted = occurring.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = occurring.join(counted.select("token"), "token", "left_semi").groupBy("c").agg(F.count("*").alias("shared"))
    reach = durable(shared.join(whole.select("c", "n_shingles"), "c").where(F.col("shared") + places > 0).select("c"))
    release(reach)
    # both sets of a linked pair are within reach, so the order may be counted anew among these few
    full = whole.join(small_side(reach, 16), "c")
    occurring = full.select("c", "n_shingles", F.explode("tokens").alias("token"))
    counted = occurring.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = occurring.join(counted, "token").withColumn("shared", F.count("*").over(Window.partitionBy("c"))).withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy("df", "token")))
    prefix = durable(ranked.where(F.col("place") <= F.col("shared") + places).select("c", "n_shingles", "token"))
    release(prefix)
    heads = prefix.groupBy("token").agg(F.min("c").alias("head"), F.count("*").alias("df")).where("df > 1")
    listed = durable(prefix.join(heads, "token"))
    clusters = components(listed.where(F.col("df") > LIST).select(F.col("c").alias("a"), F.col("head").alias("b")))
    clusters = durable(clusters.select(F.col("node").alias("c"), F.col("component").alias("cluster")))
    told = _told_pairs(full, listed.where(F.col("df") <= LIST), clusters, t, spare)
    found = _tiled_pairs(full, clusters, t)
    remove_whole()
    release(found)

    edges = found.where("b is not null").select("a", "b").union(told.select("a", "b"))
    joined = components(edges)
    links = found.where("b is null").select(F.col("a").alias("c"), "links").union(told.select(F.col("a"), "of_b")).union(told.select(F.col("b"), "of_a"))
    links = links.groupBy("c").agg(F.sum("links").alias("links"))
    labelled = classes.select("c", "k", "least", "members").join(joined.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c")).join(links, "c", "left")
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return first, labelled.join(ids, "component").select("k", "component", "component_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def _told_pairs(full: DataFrame, lists: DataFrame, clusters: DataFrame, t: int, spare) -> DataFrame:
    """(a, b, of_a, of_b): linked pairs of short posting lists and the members of both, without those of one cluster.

    A list gives at most LIST * (LIST - 1) / 2 pairs; each pair is asked under the other two orders and
    then verified on the whole sets.
    """
    side = lambda x: lists.select("token", F.col("c").alias(x), F.col("n_shingles").alias(f"n_{x}"))
    sizes = (100 * F.col("n_a") >= t * F.col("n_b")) & (100 * F.col("n_b") >= t * F.col("n_a"))
    pairs = side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & sizes).select("a", "b").distinct()
    of = small_side(clusters, 24)
    for x in ("a", "b"):
        pairs = pairs.join(of.select(F.col("c").alias(x), F.col("cluster").alias(f"in_{x}")), x, "left")
    pairs = pairs.where("in_a is null or in_b is null or in_a <> in_b").select("a", "b")
    for x in ("a", "b"):
        pairs = pairs.join(full.select(F.col("c").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("members").alias(f"of_{x}"), F.col("tokens").alias(f"t_{x}")), x)
    head = lambda x: F.slice(f"t_{x}", F.lit(1), (spare(F.col(f"n_{x}")) + 1).cast("int"))
    tail = lambda x: F.slice(f"t_{x}", -(spare(F.col(f"n_{x}")) + 1).cast("int"), (spare(F.col(f"n_{x}")) + 1).cast("int"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    linked = 100 * shared >= t * (F.col("n_a") + F.col("n_b") - shared)
    return durable(pairs.where(F.arrays_overlap(head("a"), head("b")) & F.arrays_overlap(tail("a"), tail("b")) & linked).select("a", "b", "of_a", "of_b"))


def _tiled_pairs(full: DataFrame, clusters: DataFrame, t: int) -> DataFrame:
    """(a, b, null): edges that connect what the links of clusters connect; (a, null, links): a class's links to rows.

    A cluster's classes are dealt by size into buckets of the ratio t/100, buckets into parts of about
    PART classes. Linked sets lie in one bucket or two neighbours, so that only these parts meet in tiles.
    """
    width = max(math.log(100 / t) * 1.0001, 1e-6)  # a little more than the ratio, so that rounding loses no pair
    sized = clusters.join(full.select("c", F.floor(F.log("n_shingles") / width).alias("bucket")), "c")
    parts = durable(sized.groupBy("cluster", "bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    near = lambda step, name: parts.select("cluster", (F.col("bucket") + step).alias("bucket"), F.col("parts").alias(name))
    dealt = sized.join(parts, ["cluster", "bucket"]).join(near(-1, "above"), ["cluster", "bucket"], "left").join(near(1, "below"), ["cluster", "bucket"], "left")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    own = F.col("own")
    tile = lambda bucket, i, j, across: F.struct(bucket.alias("bucket"), i.alias("i"), j.alias("j"), across.alias("across"))
    up_to = lambda n, f: F.when(F.coalesce(n, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), n - 1), f))
    no = F.array().cast("array<struct<bucket:bigint,i:int,j:int,across:boolean>>")
    within = up_to(F.col("parts"), lambda x: tile(F.col("bucket"), F.least(own, x), F.greatest(own, x), F.lit(False)))
    above = up_to(F.col("above"), lambda x: tile(F.col("bucket"), own, x, F.lit(True)))
    below = up_to(F.col("below"), lambda x: tile(F.col("bucket") - 1, x, own, F.lit(True)))
    dealt = dealt.withColumn("tile", F.explode(F.concat(within, F.coalesce(above, no), F.coalesce(below, no))))
    side = F.when(F.col("tile.across"), F.col("bucket")).otherwise(F.col("own"))
    tiles = dealt.select("c", "cluster", "tile.*", side.alias("side")).join(full, "c")

    def meet(table: pa.Table) -> pa.Table:
        keys, members, sides = (table.column(x).to_numpy() for x in ("c", "members", "side"))
        across = table.column("across")[0].as_py() or table.column("i")[0].as_py() != table.column("j")[0].as_py()
        rows: dict[str, list] = {"a": [], "b": [], "links": []}
        if len(keys) > 1:
            column = table.column("tokens").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            lists = np.split(column.flatten().to_numpy(), (column.offsets.to_numpy() - column.offsets[0].as_py())[1:-1])
            left, right = tile_links(sides, lists, t, across)
            links = np.bincount(left, members[right], len(keys)) + np.bincount(right, members[left], len(keys))
            for a, b in _forest(len(keys), left, right):
                rows["a"].append(keys[a]), rows["b"].append(keys[b]), rows["links"].append(None)
            for i in np.flatnonzero(links):
                rows["a"].append(keys[i]), rows["b"].append(None), rows["links"].append(int(links[i]))
        give_back()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in rows.items()})

    return durable(tiles.groupBy("cluster", "bucket", "i", "j", "across").applyInArrow(meet, "a long, b long, links long"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, t: int = 90) -> DataFrame:
    """One row of each component: of its least id (null comes last), of that the least by hash of the text.

    Rows are told apart by id and text, so that a repeated id or none costs no other text; rows equal in
    both are one, whatever their other columns are. Rows without words stay.
    """
    columns = docs.columns
    own = [F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest")]
    first, of_class = _linked(docs.select(*own, F.col(text).alias("text")), n, t, ["doc_id", "digest"])
    rows = first.where("k is not null").groupBy("doc_id", "digest").agg(F.first("k").alias("k"), F.count("*").alias("copies")).join(of_class.select("k", "component"), "k")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best"))
    fine = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    drop = rows.join(best, "component").withColumn("fine", fine).where("not fine or copies > 1")
    drop = durable(drop.select(F.col("doc_id").alias("__vf_id"), F.col("digest").alias("__vf_digest"), "fine"))
    same = lambda side: F.col(doc_id).cast("long").eqNullSafe(side["__vf_id"]) & (F.xxhash64(text) == side["__vf_digest"])
    kept = docs.join(drop.drop("fine"), same(drop), "left_anti")
    repeated = drop.where("fine").drop("fine")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    once = docs.join(repeated, same(repeated), "left_semi").groupBy(*own).agg(F.min_by(whole, F.to_json(whole)).alias("__vf_row"))
    return kept.union(once.select("__vf_row.*"))
