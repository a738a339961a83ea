"""Selection of predictions: rows (keys, ordinal, label, score FLOAT), the ordinal being the input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import f32

# Fixed values of the selection rule.
TOP, CONFIDENT = 5, 0.90


def _order(score: str, ordinal: str) -> list:
    # NaN sorts below everything, as a comparison that ignores it would leave it last
    return [F.desc(F.when(F.isnan(score), f32("-inf")).otherwise(F.col(score))), F.asc(ordinal)]


def select_top(preds: DataFrame, keys: list[str], score: str = "score", ordinal: str = "ordinal", rank: str = "rank") -> DataFrame:
    """The five highest of each group, and all above 0.90 (strictly); ties keep input order. One window, one pass."""
    w = Window.partitionBy(*keys).orderBy(*_order(score, ordinal))
    return preds.withColumn(rank, F.row_number().over(w)).where((F.col(rank) <= TOP) | (F.col(score) > f32(CONFIDENT)))


def flat_top(preds: DataFrame, keys: list[str], threshold: float = 0.5, most: int | None = None, score: str = "score", ordinal: str = "ordinal", rank: str = "rank") -> DataFrame:
    """Scores of at least `threshold`, highest first, at most `most` of them."""
    w = Window.partitionBy(*keys).orderBy(*_order(score, ordinal))
    out = preds.where(F.col(score) >= f32(threshold)).withColumn(rank, F.row_number().over(w))
    return out if most is None else out.where(F.col(rank) <= most)


def triggered(preds: Column, labels: list[int], threshold: float) -> Column:
    """Whether an array of (label, score) has one of `labels` with at least `threshold`."""
    return F.coalesce(F.exists(preds, lambda p: p["label"].isin(*labels) & (p["score"] >= f32(threshold))), F.lit(False)) if labels else F.lit(False)


def output_triggers(output: Column, labels: list[int], threshold: float) -> Column:
    """The same on a model output: its classification, or a scan's aggregate."""
    return triggered(F.coalesce(output["classification"], output["frame_scan"]["aggregated"]), labels, threshold)


def as_array(preds: DataFrame, keys: list[str], order: str = "rank") -> DataFrame:
    """One row a group with `classification`, the ordered array of (label, score)."""
    packed = F.array_sort(F.collect_list(F.struct(order, "label", "score")))
    return preds.groupBy(*keys).agg(F.transform(packed, lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score"))).alias("classification"))
