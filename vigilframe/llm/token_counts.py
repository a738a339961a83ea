"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by the number of tokens of their whole text; suffix sums over that
histogram answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import durable

#: Lengths of one block of the two-level suffix sums.
BLOCK = 1024


def with_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """One column `length`: tokens of each whole text; null and empty texts have length 0."""
    return bpe.lengths(docs, path, pattern, text)


def histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, with what the suffix sums say of it as a context limit.

    length; n_docs and n_tokens of documents that long; docs_longer and tokens_longer; total_docs and
    total_tokens; quantile: share of documents not longer; truncated_tokens: tokens left when every
    document is cut to this length; padded_tokens: places taken when every document fills it.

    Partial sums make the aggregate safe for a length that many documents share. Suffix sums have two
    levels: within blocks of BLOCK lengths, and over the blocks' sums, a table of at most the longest
    length / BLOCK rows. An empty table gives none; null lengths are left out.
    """
    counts = durable(lengths.where("length is not null").groupBy("length").agg(F.count("*").alias("n_docs")))  # read twice below
    counts = counts.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"], *[F.sum(c).over(whole).alias(f"{c}_all") for c in "dt"])
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = [F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_within") for c in ("n_docs", "n_tokens")]
    return (
        counts.select("*", *longer)
        .join(blocks, "block")
        .select(
            "length", "n_docs", "n_tokens",
            (F.col("n_docs_within") + F.col("d_after")).alias("docs_longer"),
            (F.col("n_tokens_within") + F.col("t_after")).alias("tokens_longer"),
            F.col("d_all").alias("total_docs"), F.col("t_all").alias("total_tokens"),
        )
        .withColumn("quantile", (F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs"))
        .withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer"))
        .withColumn("padded_tokens", F.col("length") * F.col("total_docs"))
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_longer, truncated_tokens) for any context limits, from `histogram`'s rows alone."""
    asked = [F.struct(F.lit(int(x)).cast("long").alias("limit")) for x in limits]
    each = hist.select("length", "n_docs", F.explode(F.array(*asked)).alias("x")).select("length", "n_docs", "x.limit")
    return each.groupBy("limit").agg(
        F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(F.lit(0))).alias("docs_longer"),
        F.sum(F.least("length", "limit") * F.col("n_docs")).alias("truncated_tokens"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length such that at least that share of documents is not longer."""
    each = hist.select("length", "quantile", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    return each.where(F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
