"""Mixing sources to target weights by capped water-filling, with seeded repetitions of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, written

#: Hash ranges per source in which the fractional repetition is cut; bounds a group to 1/4096 of a source.
RANGES_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """The number of words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_filling(sources: DataFrame, epochs: int, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add `target` to (source, source_size): one row per source.

    Sources in code point order, null last, weigh `weights` in turn and share the total size; none gets
    more than epochs * source_size. The sources clamped are those of least cap to weight: with the
    first m of that order clamped, the level of the rest is (total - their caps) / (remaining weight),
    and m is the first for which no further cap lies below its level. Sizes and weights are whole
    numbers, so targets do not depend on the order of sums.
    """
    everything, so_far = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*[F.lit(w) for w in weights])
    return (
        sources.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.get(turn, F.col("nth") % len(weights)).cast("long"))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(so_far), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0)))
        # a source stays below its cap iff the level reached before it does not exceed cap / weight
        .withColumn("free", F.col("left_size") * F.col("weight") <= F.col("cap") * F.col("left_weight"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "nth", "left_size", "left_weight"))).over(everything))
        .withColumn("target", F.when(F.col("free"), (F.col("weight") * F.col("level.left_size")).cast("double") / F.col("level.left_weight").cast("double")).otherwise(F.col("cap").cast("double")))
        .select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target")).alias("target"))
    )


def decisions(docs: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, whole, more) for each distinct id, source and size.

    The whole repetitions go to every document. The fraction left of a source's target goes to
    documents in the order of a seeded hash of their id, as far as they fit, passing over those longer
    than it; then to one more, the one whose size is nearest to what still lacks, if that brings the
    source nearer its target. `more` of the `rows` that share id, source and size get it.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    slim = durable(slim.withColumn("hash", hashed).withColumn("range", F.conv(F.substring("hash", 1, RANGES_BITS // 4), 16, 10).cast("int")).withColumn("words", F.col("rows") * F.col("size")))
    ranges = slim.groupBy("source", "range").agg(F.sum("words").alias("range_words"))
    targets = water_filling(ranges.groupBy("source").agg(F.sum("range_words").alias("source_size")), epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # a document longer than the rest never fits and must not stand in the way of those behind it
    counted = F.when((F.col("size") > 0) & (F.col("size") <= F.col("rest")), F.col("words")).otherwise(F.lit(0))
    sized = slim.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "source_size", "target", "whole", "rest").withColumn("counted", counted)
    begins = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sized.groupBy("source", "range").agg(F.sum("counted").alias("range_words")).withColumn("begin", F.coalesce(F.sum("range_words").over(begins), F.lit(0)))
    own = Window.partitionBy("source", "range").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("end", F.sum("counted").over(own)).alias("d").join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.range") == F.col("r.range")))
    room = F.floor((F.col("rest") - (F.col("begin") + F.col("end") - F.col("counted"))) / F.col("size"))
    fits = F.when(F.col("counted") > 0, F.greatest(F.lit(0), F.least("rows", room))).otherwise(F.lit(0)).cast("long")
    placed = durable(placed.select("d.doc_id", "d.source", "size", "rows", "hash", "source_size", "target", "whole", "rest", fits.alias("fits")))
    lacks = placed.groupBy("source").agg((F.first("rest") - F.sum(F.col("fits") * F.col("size"))).alias("lack"))
    off = F.abs(F.col("size") - F.col("lack"))
    fill = (
        placed.where("fits < rows and size > 0").alias("p").join(lacks.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source"))).where(off < F.col("lack"))
        .groupBy("p.source").agg(F.min(F.struct(off.alias("off"), "hash", "doc_id", "size")).alias("x"))
        .select(F.col("source").alias("fill_source"), F.col("x.doc_id").alias("fill_id"), F.col("x.size").alias("fill_size"))
    )
    joined = placed.join(fill, F.col("source").eqNullSafe(F.col("fill_source")) & F.col("doc_id").eqNullSafe(F.col("fill_id")) & (F.col("size") == F.col("fill_size")), "left")
    return joined.select("doc_id", "source", "size", "rows", "source_size", "target", "whole", (F.col("fits") + F.col("fill_size").isNotNull().cast("long")).alias("more"))


def _numbered(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Add `number`: 1, 2, ... within each key, however many rows it has.

    Rows are written, sorted by key within each file; a row's number is its place in its file's part of
    the key, and what the files before have of the key.
    """
    table, _ = written(rows.withColumn("__vf_mix_key", F.xxhash64(*keys)).sortWithinPartitions("__vf_mix_key"))
    placed = table.withColumn("__vf_mix_file", F.col("_metadata.file_path")).withColumn("__vf_mix_at", F.col("_metadata.row_index"))
    parts = placed.groupBy("__vf_mix_key", "__vf_mix_file").agg(F.min("__vf_mix_at").alias("__vf_mix_first"), F.count("*").alias("__vf_mix_n"))
    before = Window.partitionBy("__vf_mix_key").orderBy("__vf_mix_file").rowsBetween(Window.unboundedPreceding, -1)
    parts = durable(parts.withColumn("__vf_mix_before", F.coalesce(F.sum("__vf_mix_n").over(before), F.lit(0))).drop("__vf_mix_n"))
    joined = placed.join(parts, ["__vf_mix_key", "__vf_mix_file"])
    return joined.withColumn(number, F.col("__vf_mix_before") + F.col("__vf_mix_at") - F.col("__vf_mix_first") + 1).select(*rows.columns, number)


def mix(docs: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Add size, source_size, target, taken (words) and repeats (whole copies of the document).

    No document is taken more than `epochs` times, and a source's words differ from its target by less
    than one document. The hash order is cut in 2**RANGES_BITS ranges per source: totals per source and
    range are pre-aggregated, a running total over ranges gives where each begins, and running totals
    over documents stay within a range, so no source is one task. Texts are read twice, for their sizes
    and to carry them along; decisions hold ids and numbers only.

    Reruns agree. Nulls: text counts 0 words, a null source is a source of its own, a null id hashes as
    `null`. Rows equal in id, source and size follow one another; where the fraction ends among them,
    some of them have it (which, is left open), and these few groups are written and numbered. An
    empty table gives none. Columns of `docs` named like an output are replaced; all others are kept.
    """
    names = ("size", "source_size", "target", "taken", "repeats")
    kept = docs.drop(*[c for c in names if c in docs.columns])
    found = decisions(docs, epochs, weights, seed, doc_id, text, source).select(F.col("doc_id").alias("__vf_mix_id"), F.col("source").alias("__vf_mix_source"), F.col("size").alias("__vf_mix_size"), "rows", "source_size", "target", "whole", "more")
    joined = kept.withColumn("size", words(text)).join(found.withColumnsRenamed({c: f"__vf_mix_{c}" for c in ("rows", "whole", "more")}), F.col(doc_id).eqNullSafe(F.col("__vf_mix_id")) & F.col(source).eqNullSafe(F.col("__vf_mix_source")) & (F.col("size") == F.col("__vf_mix_size")))
    split = (F.col("__vf_mix_more") > 0) & (F.col("__vf_mix_more") < F.col("__vf_mix_rows"))
    own = (*kept.columns, "size", "source_size", "target")
    even = joined.where(~split).select(*own, (F.col("__vf_mix_whole") + (F.col("__vf_mix_more") > 0).cast("long")).alias("repeats"))
    if not found.where("more > 0 and more < rows").isEmpty():
        odd = joined.where(split).select(*own, "__vf_mix_whole", "__vf_mix_more", "__vf_mix_id", "__vf_mix_source")
        odd = _numbered(odd, ["__vf_mix_id", "__vf_mix_source", "size"], "__vf_mix_nth")
        even = even.union(odd.select(*own, (F.col("__vf_mix_whole") + (F.col("__vf_mix_nth") <= F.col("__vf_mix_more")).cast("long")).alias("repeats")))
    return even.withColumn("taken", F.col("size") * F.col("repeats")).select(*kept.columns, *names)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as its `repeats` says; those with none go."""
    return mixed.where("repeats > 0").withColumn("__vf_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(*columns)
