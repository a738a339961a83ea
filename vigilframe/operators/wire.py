"""What a client sends and sees: requests as submissions, and a task's one result arm (error, state or models)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import error_number

# Wire numbers of states.
TASK_NUMBERS = {"queued": 0, "processing": 1, "completed": 2, "failed": 4, "cancelled": 5}
MODEL_NUMBERS = {"queued": 0, "processing": 1, "done": 2, "failed": 4, "skipped": 5}


_URL = "struct<main:string,fallback:string>"
#: A request: one of the inputs, and models or a pipeline.
REQUEST = f"image_url {_URL}, video_url {_URL}, audio_url {_URL}, text string, models array<string>, pipeline string"


def requests(lines: DataFrame, request: str = "request") -> DataFrame:
    """Requests, JSON text in a column, as (other columns, input, models, pipeline, problem).

    What is no JSON object, has no input or more than one, or neither models nor a pipeline, has a
    `problem` and no input. URLs may name a fallback; an empty list of models is none.
    """
    r = F.from_json(F.col(request), REQUEST)
    kinds = {"image": r["image_url"], "video": r["video_url"], "audio": r["audio_url"]}
    none = F.lit(None).cast("string")
    some = [u["main"].isNotNull() for u in kinds.values()] + [r["text"].isNotNull()]
    many = sum((x.cast("int") for x in some), F.lit(0))
    models = F.coalesce(r["models"], F.array().cast("array<string>"))
    problem = (
        F.when(r.isNull() | ~F.coalesce(F.trim(F.col(request)).startswith("{"), F.lit(False)), "the request cannot be read")
        .when(many == 0, "an input is required")
        .when(many > 1, "only one input is allowed")
        .when((F.size(models) == 0) & r["pipeline"].isNull(), "models or a pipeline are required")
    )
    kind = F.coalesce(*[F.when(u["main"].isNotNull(), F.lit(k)) for k, u in kinds.items()], F.lit("text"))
    urls = [F.coalesce(*[u[part] for u in kinds.values()]) for part in ("main", "fallback")]
    given = F.struct(kind.alias("kind"), urls[0].alias("main"), urls[1].alias("fallback"), r["text"].alias("text"), none.alias("path"), (kind == "video").alias("video"))
    rest = [F.col(f"`{c}`") for c in lines.columns if c not in (request, "input", "models", "pipeline", "problem")]
    return lines.select(*rest, F.when(problem.isNull(), given).alias("input"), models.alias("models"), r["pipeline"].alias("pipeline"), problem.alias("problem"))


def _number(state: Column, numbers: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]), state)


def model_arm(state: Column, output: Column, error: Column) -> Column:
    """A model's result: its error, else its output, else its state."""
    return F.struct(
        error.alias("error"),
        F.when(error.isNull(), output).alias("output"),
        F.when(error.isNull() & output.isNull(), _number(state, MODEL_NUMBERS)).alias("state"),
    )


def task_view(tasks: DataFrame, items: DataFrame, results: DataFrame) -> DataFrame:
    """(task_id, arm, error_kind, error_message, state, models): as a client reads a task.

    Only item 0 shows; without items there is no arm. An item's error wins over the task's state (a
    cancelled item shows as an error once it has one). Models show when the task is completed; a failed
    task without an item error gives a general one.
    """
    first = items.where("idx = 0").select("task_id", F.col("error").alias("_error"), F.lit(True).alias("_item"))
    packed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", model_arm(F.col("state"), F.col("output"), F.col("error"))))))
    models = results.where("item_idx = 0").groupBy("task_id").agg(packed.alias("_models"))
    joined = tasks.join(first, "task_id", "left").join(models, "task_id", "left")
    has = F.coalesce("_item", F.lit(False))
    state = F.col("state")
    arm = F.when(~has, F.lit(None).cast("string")).when(F.col("_error").isNotNull() | (state == "failed"), "error").when(state == "completed", "models").otherwise("state")
    return joined.withColumn("arm", arm).select(
        "task_id", "arm",
        F.when(F.col("arm") == "error", error_number(F.coalesce(F.col("_error.kind"), F.lit("unspecified")))).alias("error_kind"),
        F.when(F.col("arm") == "error", F.coalesce(F.col("_error.message"), F.lit("the task failed"))).alias("error_message"),
        F.when(F.col("arm") == "state", _number(state, TASK_NUMBERS)).alias("state"),
        F.when(F.col("arm") == "models", F.col("_models")).alias("models"),
    )


def task_trees(tasks: DataFrame, items: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks with their items as an ordered array, each with its results by label. Two aggregates, two joins."""
    by_item = results.groupBy("task_id", "item_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("state", "output", "error"))))).alias("results"))
    listed = items.join(by_item.withColumnRenamed("item_idx", "idx"), ["task_id", "idx"], "left")
    packed = listed.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("idx", "state", "results"))).alias("items"))
    return tasks.join(packed, "task_id", "left")
