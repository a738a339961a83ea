"""Ordered pipelines: resolution of steps and the gates that skip what follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(items: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Items with a pipeline get its models in step order (replacing their own); unknown names give an error.

    `pipelines` is (pipeline, order, model): configuration, so its ordered lists are small; Spark
    broadcasts them if their size allows.
    """
    steps = pipelines.groupBy("pipeline").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "model"))), lambda s: s["model"]).alias("_steps"))
    joined = items.join(steps, "pipeline", "left")
    models = F.when(F.col("pipeline").isNull(), F.col("models")).otherwise(F.col("_steps"))
    problem = F.when(F.col("pipeline").isNotNull() & F.col("_steps").isNull(), F.concat(F.lit("unknown pipeline: "), F.col("pipeline")))
    return joined.withColumn("models", models).withColumn("pipeline_error", problem).drop("_steps")


def gate_states(steps: DataFrame, keys: list[str], fires: Column, order: str = "step", done: Column | None = None) -> DataFrame:
    """Add `state`: steps after the first gate that fires are skipped, unless they are done already."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    fired = F.coalesce(F.max(F.coalesce(fires, F.lit(False)).cast("int")).over(before), F.lit(0)) == 1
    kept = F.lit(False) if done is None else F.coalesce(done, F.lit(False))
    return steps.withColumn("state", F.when(fired & ~kept, F.lit("skipped")).otherwise(F.lit("done")))


def fail_from(steps: DataFrame, keys: list[str], failed: Column, order: str = "step") -> DataFrame:
    """A step out of retries and all later steps that are not done become failed (not skipped)."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce(F.max(F.coalesce(failed, F.lit(False)).cast("int")).over(upto), F.lit(0)) == 1
    return steps.withColumn("state", F.when(hit & ~F.col("state").isin("done", "skipped"), F.lit("failed")).otherwise(F.col("state")))


def run_steps(items: DataFrame, orders: list[int], classify, fires, key: str = "item") -> DataFrame:
    """Run steps one after the other, each only on the items that no gate has stopped.

    `classify(items, order)` gives the step's outputs with `key`; `fires` is a condition on them. The
    loop is over the configured steps, not over data; each step's output is checkpointed by the caller.
    """
    alive, outputs = items, []
    for order in sorted(orders):
        out = classify(alive, order).withColumn("step", F.lit(order))
        outputs.append(out)
        alive = alive.join(out.where(fires).select(key).distinct(), key, "left_anti")
    result = outputs[0]
    for out in outputs[1:]:
        result = result.unionByName(out)
    return result
