"""Frame scans: what is left to do, where a scan stops, and pooling of frame predictions by label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import f32
from .select import select_top


def pool_scores(preds: DataFrame, keys: list[str], how: str = "mean", frame: str = "frame_index") -> DataFrame:
    """(keys, label, score): mean over *all* frames of the group (also those without the label), or maximum.

    Accumulated in DOUBLE. Frames are counted with the same partitioning as the labels' aggregate.
    """
    if how not in ("mean", "average", "max"):
        raise ValueError(f"unknown aggregation: {how}")
    if how == "max":
        return preds.groupBy(*keys, "label").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("score"))
    frames = preds.groupBy(*keys).agg(F.countDistinct(frame).alias("_frames"))
    sums = preds.groupBy(*keys, "label").agg(F.sum(F.col("score").cast("double")).alias("_sum"))
    return sums.join(frames, keys).select(*keys, "label", (F.col("_sum") / F.col("_frames")).cast("float").alias("score"))


def pool(preds: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """Pooled scores after selection; ties by ascending label."""
    return select_top(pool_scores(preds, keys, how), keys, ordinal="label")


def until_trigger(frames: DataFrame, keys: list[str], fires: Column, order: str = "frame_index") -> DataFrame:
    """The frames up to and including the first that fires; all if none does."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("_fired", F.max(fires.cast("int")).over(before)).where(F.coalesce("_fired", F.lit(0)) == 0).drop("_fired")


def fires(labels: list, threshold: float, label: str = "label", score: str = "score") -> Column:
    return F.coalesce(F.col(label).isin(*labels) & (F.col(score) >= f32(threshold)), F.lit(False)) if labels else F.lit(False)


def early_exit(strategy_flag: Column, labels: Column) -> Column:
    """A scan may stop early if its strategy says so and its model names trigger labels."""
    return F.coalesce(strategy_flag, F.lit(False)) & (F.size(F.coalesce(labels, F.array().cast("array<bigint>"))) > 0)


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned frames that have no stored classification yet."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def batches(frames: DataFrame, keys: list[str], size: int, order: str = "frame_index") -> DataFrame:
    """Number the batches of `size` frames that a group is classified in."""
    w = Window.partitionBy(*keys).orderBy(order)
    return frames.withColumn("batch", F.floor((F.row_number().over(w) - 1) / F.lit(size)).cast("long"))


def scan_in_batches(frames: DataFrame, keys: list[str], classify: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], size: int = 8, growth: int = 2, order: str = "frame_index", store: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames as far as each scan goes, (keys, n_classified)): a scan ends with its first frame that fires.

    Rounds over all scans at once: the first classifies `size` frames of each, every later one `growth`
    times as many of those that go on, so rounds are logarithmic in the longest scan and no frame beyond
    the batch that fires is classified. `classify` gives (keys, order, fires, ...) of frames; `keep`
    writes a round's rows once, and `store` gets those that count before the next round begins, so that
    what a lost driver leaves undone is one round.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    # batch r begins at size * (growth**r - 1) / (growth - 1)
    if growth > 1:
        batch = F.floor(F.log(float(growth), place * (growth - 1) / F.lit(float(size)) + 1) + 1e-9)
    else:
        batch = F.floor(place / size)
    left = keep(frames.withColumn("_batch", batch.cast("int")))
    kept = counts = None
    turn = 0
    while True:
        now = left.where(F.col("_batch") == turn).drop("_batch")
        if now.isEmpty():
            break
        got = keep(classify(now))
        mine = until_trigger(got, keys, F.coalesce("fires", F.lit(False)), order)
        if store:
            store(mine)
        n = got.groupBy(*keys).agg(F.count("*").alias("_n"))
        kept, counts = (mine, n) if kept is None else (kept.unionByName(mine), counts.unionByName(n))
        left = left.join(got.where("fires").select(*keys).distinct(), keys, "left_anti")
        turn += 1
    if kept is None:
        kept, counts = classify(frames.limit(0)), frames.limit(0).groupBy(*keys).agg(F.count("*").alias("_n"))
    return kept, counts.groupBy(*keys).agg(F.sum("_n").alias("n_classified"))


def frame_scans(frames: DataFrame, pooled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame_scan): the pooled classification and the frames in index order."""
    listed = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame_index", "timestamp", "classification"))).alias("frames"))
    top = pooled.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))), lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score"))).alias("aggregated"))
    return listed.join(top, keys, "left").select(*keys, F.struct("aggregated", "frames").alias("frame_scan"))
