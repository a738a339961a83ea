"""Result caches: by content hash, and by URL through the content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh_after(now: int, ttl: int | None) -> int:
    """Entries created at this second or later count; without a time to live all do."""
    return now - ttl if ttl else 0


def is_fresh(created_at: Column, now: int, ttl: int | None) -> Column:
    return created_at >= F.lit(fresh_after(now, ttl))


def latest(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; equal versions are taken by the greatest whole row, so reruns agree."""
    rest = [c for c in log.columns if c not in keys]
    packed = F.struct(version, *[c for c in rest if c != version])
    return log.groupBy(*keys).agg(F.max(packed).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def content_cache(wanted: DataFrame, cache: DataFrame, fresh: int = 0) -> DataFrame:
    """`wanted` (content_hash, model, revision, ...) with `output` of a fresh entry, else null.

    The predicate on created_at reaches the scan; AQE picks the join by measured size.
    """
    entries = cache.where(F.col("created_at") >= fresh).select("content_hash", "model", "revision", "output")
    return wanted.join(entries, ["content_hash", "model", "revision"], "left")


def url_cache_hits(items: DataFrame, url_cache: DataFrame, cache: DataFrame, fresh: int = 0) -> DataFrame:
    """Items all of whose models have a fresh output by way of their URL: (item, model, output).

    `items` is (item, url_hash, model, revision). The two hops are left joins; an item counts only if
    no model lacks its output. Items with a pipeline must not be given: gates have to see their steps.
    """
    hashes = url_cache.where(F.col("created_at") >= fresh).select("url_hash", "model", "revision", "content_hash")
    found = content_cache(items.join(hashes, ["url_hash", "model", "revision"], "left"), cache, fresh)
    whole = F.min(F.col("output").isNotNull()).over(Window.partitionBy("item"))
    return found.withColumn("_all", whole).where("_all").select("item", "model", "output")


def url_key(main: Column) -> Column:
    """The URL cache's key: the digest of the main URL only, even if the bytes came from the fallback."""
    return F.sha2(main.cast("binary"), 256)
