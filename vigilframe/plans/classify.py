"""Classification as plans: pluggable batch models, image and video runs, and the service-like API."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import content_digest
from ..operators import cache as caches
from ..operators import gate, lifecycle, pool, sampling, select, wire
from ..sources import media
from ..sources.store import Store
from .worker import Model

PREDICTIONS = "array<struct<label:bigint,score:float>>"
#: The name by which callers know it.
batch_model = Model


def classify_images(items: DataFrame, model: Model, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, classification): every image's selected predictions; those of failed ones are null."""
    return items.select(*keys, model(F.col(content))["classification"].alias("classification"))


def frame_plan(videos: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame_index, timestamp) of videos (keys, strategy, duration, fps, probed map by step) by their strategy's steps.

    `steps` is configuration; the fold that merges a video's times stays inside its row.
    """
    joined = videos.join(steps, "strategy")
    probed = F.try_element_at(F.col("probed"), F.col("step")) if "probed" in videos.columns else F.array().cast("array<double>")
    times = sampling.step_times(F.col("method"), F.col("duration"), F.col("fps"), F.col("count"), F.col("rate"), F.col("nth"), probed)
    packed = F.transform(F.array_sort(F.collect_list(F.struct("step", "times"))), lambda s: s["times"])
    planned = joined.withColumn("times", times).groupBy(*keys, "duration", "fps").agg(packed.alias("_steps"))
    return planned.select(*keys, F.posexplode(sampling.merge_steps(F.col("_steps"), F.col("duration"), F.col("fps"))).alias("frame_index", "timestamp"))


def scan_videos(planned: DataFrame, done: DataFrame, extract_and_classify: Callable[[DataFrame], DataFrame], keys: list[str], how: str = "mean", labels: list[int] | None = None, threshold: float = 0.9, batch: int = 8, growth: int = 2, keep: Callable[[DataFrame], DataFrame] | None = None, store: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(keys, frame_scan): pending frames classified batch by batch as far as a trigger, joined by the stored ones, pooled.

    `extract_and_classify` gives (keys, frame_index, timestamp, ordinal, label, score) of frames, and is only
    asked for frames up to the batch in which a trigger fires (see pool.scan_in_batches). `store` gets
    each round's frames (keys, frame_index, timestamp, classification) before the next is asked for. Stored
    frames are not tested for triggers again: only new frames stop a scan.
    """
    keep = keep or (lambda rows: rows.checkpoint(eager=True))

    def classify(pending: DataFrame) -> DataFrame:
        frame = [*keys, "frame_index", "timestamp"]
        found = select.as_array(select.select_top(extract_and_classify(pending), [*keys, "frame_index"]), frame)
        fires = select.triggered(F.col("classification"), labels, threshold) if labels else F.lit(False)
        return pending.select(*frame).join(found, frame, "left").withColumn("fires", fires)

    fresh, _ = pool.scan_in_batches(pool.pending(planned, done, [*keys, "frame_index"]), keys, classify, keep, batch, growth, store=store)
    frame = [*keys, "frame_index", "timestamp", "classification"]
    return assembled_scans(done.select(*frame).unionByName(fresh.where("classification is not null").select(*frame)), keys, how)


def assembled_scans(frames: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """(keys, frame_scan) of classified frames (keys, frame_index, timestamp, classification)."""
    each = frames.select(*keys, "frame_index", F.explode("classification").alias("p")).select(*keys, "frame_index", "p.label", "p.score")
    return pool.frame_scans(frames, pool.pool(each, keys, how), keys)


def scan_lazily(videos: DataFrame, keys: list[str], model: Model, labels: list[int] | None, threshold: float, run=media.run_tool, content: str = "content", times: str = "times") -> DataFrame:
    """(keys, frame_index, timestamp, classification, error, fires): each video's frames at its `times`, as far as the scan goes.

    A video's frames are extracted and classified one model batch at a time; the frame at which a
    trigger fires, or the first that fails, is the last. The batches after it are neither extracted nor
    classified, those before it left as rows. A video lies in a file of its task for that time.
    """
    trigger, least = set(labels or ()), float(np.float32(threshold))
    schema = T.StructType(
        [*(videos.schema[k] for k in keys), T.StructField("frame_index", T.LongType()), T.StructField("timestamp", T.DoubleType()), *T.StructType.fromDDL(f"classification {PREDICTIONS}, error string, fires boolean").fields]
    )

    def frames_of(file: str, wanted: list[dict]):
        for k in range(0, len(wanted), model.batch_size):
            chunk = wanted[k : k + model.batch_size]
            got = [media.one_frame(file, float(t["timestamp"]), run) for t in chunk]
            lost = next(((t, problem) for t, (frame, problem) in zip(chunk, got) if frame is None), None)
            if lost:  # a batch that cannot be extracted is not classified
                yield lost[0], None, lost[1], False
                return
            for t, (found, problem) in zip(chunk, model.ask([frame for frame, _ in got])):
                fires = problem is None and any(label in trigger and score >= least for label, score in found)
                yield t, found, problem, fires
                if fires or problem is not None:
                    return

    def each(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                own = tuple(row[k] for k in keys)

                def scan(file, row=row, own=own):
                    return [(*own, int(t["frame_index"]), float(t["timestamp"]), None if found is None else [{"label": n, "score": x} for n, x in found], problem, fires) for t, found, problem, fires in frames_of(file, list(row[times]))]

                yield pd.DataFrame(media.on_file(row[content], scan), columns=schema.names)

    return videos.select(*keys, content, times).mapInPandas(each, schema)


class Engine:
    """submit, get_task, cancel and recover over a store and a configuration, as batch plans.

    Submissions are DataFrames; a single call is a one-row case of the same plan.
    """

    def __init__(self, spark: SparkSession, store: Store, models: DataFrame, pipelines: DataFrame | None = None, strategies: tuple[str, ...] = (), max_pending: int = 1024, memory_cap: int | None = None, memory_used: Callable[[], int] | None = None):
        self.spark, self.store, self.models, self.strategies = spark, store, models, list(strategies)
        self.pipelines = pipelines if pipelines is not None else spark.createDataFrame([], "pipeline string, order int, model string")
        self.max_pending, self.memory_cap, self.memory_used = max_pending, memory_cap, memory_used

    def submit(self, items: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(accepted, rejected with `problem`) of rows (task_id, idx, input, models, pipeline); accepted ones are stored.

        A task is accepted as a whole. Memory and queue limits are checked before anything is written; places in
        the queue go by arrival: a column `arrival` (a whole number), or the order of the rows.
        """
        if self.memory_cap and self.memory_used and self.memory_used() >= self.memory_cap:
            return items.limit(0), items.withColumn("problem", F.lit("memory"))
        arrival = F.col("arrival").cast("long") if "arrival" in items.columns else F.monotonically_increasing_id()
        keyed = self.store.durable(items.withColumn("_arrival", arrival)).withColumn("item", F.concat_ws("#", "task_id", "idx"))
        resolved = gate.resolve(lifecycle.submissions(keyed.withColumn("kind", F.col("input.kind")).withColumn("video", F.col("input.video"))), self.pipelines)
        checked = resolved.join(lifecycle.validate_items(resolved, self.models, self.strategies).withColumnRenamed("problem", "_rule"), "item")
        judged = checked.withColumn("problem", F.coalesce("problem", "pipeline_error", "_rule"))
        bad = judged.groupBy("task_id").agg(F.min("problem").alias("_task_problem"), F.count("*").alias("_n"), F.min("_arrival").alias("_arrival"))
        waiting = self.store.table("items").where(~F.col("state").isin("completed", "failed", "cancelled")).count()
        sound = bad.where("_task_problem is null").withColumn("_queue", F.lit(0))
        good = lifecycle.within_capacity(sound, waiting, self.max_pending, ["_queue"], "_arrival", "_n").where("accepted")
        accepted = judged.join(good, "task_id", "left_semi").select("task_id", F.col("idx").cast("long").alias("idx"), "input", "models", "pipeline")
        rejected = judged.join(good, "task_id", "left_anti").select("task_id", "idx", F.coalesce("problem", F.lit("queue_full")).alias("problem"))
        accepted, rejected = self.store.durable(accepted), self.store.durable(rejected)
        self.store.create_tasks(accepted)
        return accepted, rejected

    def submit_one(self, kind: str, main: str | None = None, fallback: str | None = None, text: str | None = None, path: str | None = None, video: bool = False, models: list[str] | None = None, pipeline: str | None = None) -> str:
        """The id of a task with one item; a rejection raises its problem."""
        task_id = str(uuid.uuid4())
        schema = "task_id string, idx bigint, input struct<kind:string,main:string,fallback:string,text:string,path:string,video:boolean>, models array<string>, pipeline string"
        _, rejected = self.submit(self.spark.createDataFrame([(task_id, 0, (kind, main, fallback, text, path, video), models or [], pipeline)], schema))
        if (row := rejected.first()) is not None:
            raise ValueError(row["problem"])
        return task_id

    def get_task(self, task_id: str) -> DataFrame:
        mine = F.col("task_id") == task_id
        items, tasks = self.store.table("items").where(mine), self.store.table("tasks").where(mine)
        wanted = items.select("task_id", F.col("idx").alias("item_idx"), F.explode("models").alias("label"))
        results = lifecycle.result_overlay(wanted, self.store.table("model_results").where(mine), ["task_id", "item_idx", "label"])
        return wire.task_view(tasks, items, results)

    def cancel(self, task_id: str) -> bool:
        """False if the task is terminal already; an unknown id raises."""
        row = self.store.table("tasks").where(F.col("task_id") == task_id).first()
        if row is None:
            raise KeyError(task_id)
        if row["state"] in ("completed", "failed", "cancelled"):
            return False
        self.store.set_task_state(task_id, "cancelled")
        self.cancel_items()
        return True

    def cancel_items(self) -> None:
        """Items of cancelled tasks that have not ended are cancelled; what their models gave stays."""
        gone = self.store.table("tasks").where("state = 'cancelled'").select("task_id")
        open_ = self.store.table("items").where(~F.col("state").isin("completed", "failed", "cancelled")).join(gone, "task_id", "left_semi")
        error = F.struct(F.lit("cancelled").alias("kind"), F.lit("cancelled").alias("message"))
        self.store.append("items", open_.select("task_id", "idx", F.lit("cancelled").alias("state"), error.alias("error"), F.lit(True).alias("set_error")))

    def pending_work(self, now: int | None = None, ttl: int | None = None) -> DataFrame:
        """Requested models without a result, with the cached output where there is one, in waiting order.

        Rows (task_id, idx, model, url_hash, output, priority, created_at), sorted by range: a caller that
        takes the first few reads the first part only. Items with a pipeline get no cached output here:
        their gates have to see every step.
        """
        now = int(time.time()) if now is None else now
        items = self.store.table("items").where(F.col("state").isin("queued", "processing", "retrying"))
        tasks = self.store.table("tasks").where(F.col("state").isin(*lifecycle.ACTIVE)).select("task_id", "created_at")
        each = items.join(tasks, "task_id").select("task_id", "idx", "created_at", "pipeline", F.explode("models").alias("label"), caches.url_key(F.col("input.main")).alias("url_hash"))
        done = self.store.table("model_results").where(F.col("state").isin("done", "skipped")).select("task_id", F.col("item_idx").alias("idx"), "label")
        todo = each.join(done, ["task_id", "idx", "label"], "left_anti").withColumnRenamed("label", "model").join(self.models.select("model", "revision", "priority"), "model", "left")
        hits = caches.url_cache_hits(todo.where("pipeline is null").select(F.struct("task_id", "idx").alias("item"), "url_hash", "model", "revision"), self.store.table("url_cache"), self.store.table("cache"), caches.fresh_after(now, ttl))
        hits = hits.select("item.task_id", "item.idx", "model", "output")
        joined = todo.join(hits, ["task_id", "idx", "model"], "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
        return joined.orderBy(F.desc("priority"), "created_at", "task_id", "idx", "model")

    def finish(self, results: DataFrame) -> None:
        """Store results (task_id, item_idx, label, state, output, error) and roll item and task states up."""
        self.store.append("model_results", results.withColumn("set_output", F.lit(True)))
        touched = results.select("task_id").distinct()
        items = self.store.table("items").join(touched, "task_id", "left_semi")
        wanted = items.select("task_id", F.col("idx").alias("item_idx"), F.explode("models").alias("label"))
        overlay = lifecycle.result_overlay(wanted, self.store.table("model_results").join(touched, "task_id", "left_semi"), ["task_id", "item_idx", "label"])
        ended = overlay.groupBy("task_id", F.col("item_idx").alias("idx")).agg(F.bool_and(F.col("state").isin("done", "skipped", "failed")).alias("ended"))
        self.store.append("items", ended.where("ended").join(items.where(~F.col("state").isin("completed", "failed", "cancelled")), ["task_id", "idx"]).select("task_id", "idx", F.lit("completed").alias("state")))
        self.roll_up(touched)

    def roll_up(self, touched: DataFrame) -> None:
        """Set the states of tasks (task_id) after their items' where they changed."""
        rolled = self.store.rolled_up(touched).where("state <> _was")
        self.store.append("tasks", rolled.select("task_id", "state", F.lit(self.store.now()).cast("long").alias("updated_at")))

    def recover(self, deliver: Callable[[dict], None] | None = None, uploads: DataFrame | None = None) -> DataFrame:
        """After a restart: send again what was not delivered, remove uploads that no open task needs, and
        raise attempts of interrupted tasks; beyond the limit they fail, the others are run by the next pass.

        `uploads` lists staged files (path).
        """
        if deliver:
            from ..streaming.scan import outbox

            sent = self.store.durable(outbox(self.store.items_pending_webhook().select("task_id", "idx", "state"), deliver).where("delivered"))
            self.store.append("items", sent.select("task_id", "idx", F.lit(True).alias("webhook_delivered")))
        if uploads is not None:
            needed = self.store.table("items").join(self.store.load_incomplete_tasks().select("task_id"), "task_id", "left_semi")
            media.remove_files(lifecycle.orphaned_uploads(uploads, needed.select(F.col("input.path").alias("path"))))
        found = self.store.durable(lifecycle.recover(self.store.table("tasks")))
        now = F.lit(self.store.now()).cast("long")
        self.store.append("tasks", found.select("task_id", F.lit(1).alias("attempts"), now.alias("updated_at"), F.when(F.col("action") == "fail", "failed").alias("state")))
        return found.select("task_id", "attempts", "action")


def remember(results: DataFrame, store: Store) -> None:
    """Fill both caches from rows (main, content, model, revision, output)."""
    now = F.lit(store.now()).cast("long")
    hashed = results.withColumn("content_hash", content_digest(F.col("content"))).withColumn("url_hash", caches.url_key(F.col("main")))
    store.append("cache", hashed.select("content_hash", "model", "revision", "output", now.alias("created_at")))
    store.append("url_cache", hashed.select("url_hash", "model", "revision", "content_hash", now.alias("created_at")))


# --- client builders


def image(main: str, fallback: str | None = None, models: list[str] | None = None, pipeline: str | None = None) -> dict:
    return {"kind": "image", "main": main, "fallback": fallback, "models": models, "pipeline": pipeline}


def video(main: str, fallback: str | None = None, models: list[str] | None = None, pipeline: str | None = None) -> dict:
    return {"kind": "video", "main": main, "fallback": fallback, "models": models, "pipeline": pipeline}


def audio(main: str, fallback: str | None = None, models: list[str] | None = None, pipeline: str | None = None) -> dict:
    return {"kind": "audio", "main": main, "fallback": fallback, "models": models, "pipeline": pipeline}


def text(body: str, models: list[str] | None = None, pipeline: str | None = None) -> dict:
    return {"kind": "text", "text": body, "models": models, "pipeline": pipeline}
