"""Queued work as batch plans: caches, fetching with retries, models, gates and the states that follow.

One pass handles all admitted items at once: each step below is a join, a window or an Arrow function over
their rows, and every change is appended to the store's logs. Loops are over configuration (pipeline
positions, model names, retries), never over items.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import content_digest, input_url, modality, model_done, retry_backoff
from ..operators import cache as caches
from ..operators import lifecycle, pool
from ..sources import media
from ..sources.config import Config
from ..streaming.scan import outbox
from . import classify

KEYS = ["task_id", "idx"]
MODEL = [*KEYS, "model"]
_PREDS = "array<struct<label:bigint,score:float>>"
OUTPUT = f"struct<classification:{_PREDS},frame_scan:struct<aggregated:{_PREDS},frames:array<struct<frame_index:bigint,timestamp:double,classification:{_PREDS}>>>>"


def _error(kind: str, message) -> F.Column:
    return F.struct(F.lit(kind).alias("kind"), message.alias("message"))


class Runner:
    """Runs what an engine has queued. `models` gives per model name a function that loads it (see batch_model).

    `download(url, limits) -> bytes`, `check(bytes)` (raises if they do not decode) and `tool(command) ->
    bytes` run on the executors. `slots` bounds how many items one pass admits, the highest priority first.
    `notify(row)` is told, once and without a second try, of items that begin or are tried again; ended items
    are delivered by the outbox.

    An item holds its permit from admission to its end, over retries and passes: `slots` counts those that
    are processing or retrying, and only what they leave free goes to those that are queued.
    """

    def __init__(self, engine: classify.Engine, config: Config, models: dict[str, Callable], download=media.http_download, limits: media.FetchLimits | None = None, check: Callable[[bytes], None] | None = None, tool=media.run_tool, cache: bool = True, ttl: int | None = None, slots: int | None = None, most_seconds: int = 3600, retries: int = 3, wait=time.sleep, notify: Callable[[dict], None] | None = None, most_batches: int = 64):
        self.engine, self.store, self.spark, self.config, self.models = engine, engine.store, engine.spark, config, models
        self.download, self.limits, self.check, self.tool = download, limits or media.FetchLimits(), check, tool
        self.cache, self.ttl, self.slots, self.most_seconds, self.retries, self.wait, self.notify = cache, ttl, slots, most_seconds, retries, wait, notify
        self.most_batches = most_batches
        self.revisions = engine.models.select("model", "revision")

    # --- what waits

    def run(self, linger: bool = True) -> DataFrame:
        """One pass over the waiting items; gives (task_id, idx, state) of those it ended.

        Items whose fetch failed are tried again when their back-off is over, by which time all others have
        been through their models and are stored. Without `linger` the pass does not wait for them: they
        stay as retrying, hold their permits, and a later pass takes them when they are due.
        """
        self.engine.cancel_items()
        waiting = self._admitted()
        self._append("tasks", waiting.select("task_id").distinct(), state=F.lit("processing"), updated_at=self._now())
        wanted = self._kept(self._wanted(waiting))
        ended = [self._already_done(waiting, wanted)]
        if self.cache:
            ended.append(self._from_url_cache(waiting, wanted))
        left = waiting
        for done in ended:
            left = left.join(done, KEYS, "left_anti")
            self._complete(done)
        left = self._kept(left)
        self._append("items", left.select(*KEYS), state=F.lit("processing"), set_error=F.lit(True))
        self._tell(left.select(*KEYS, F.lit("processing").alias("state")))
        while True:
            fetched, again, failed_at = self._fetched(left)
            self._complete(self._steps(fetched, wanted.join(fetched.select(*KEYS), KEYS, "left_semi")))
            if again is None or not linger:
                break
            pause = again.agg(F.min("_pause")).first()[0]
            self.wait(max(0.0, pause - (time.monotonic() - failed_at)))
            left = self._kept(self._not_cancelled(again.drop("_pause")))
        self.engine.roll_up(waiting.select("task_id").distinct())
        self._clean_uploads(waiting)
        now = self.store.table("items").join(waiting.select(*KEYS), KEYS, "left_semi")
        return now.where(F.col("state").isin("completed", "failed", "cancelled")).select(*KEYS, "state")

    def _complete(self, done: DataFrame) -> None:
        self._append("items", self._not_cancelled(done), state=F.lit("completed"), set_error=F.lit(True))

    def _admitted(self) -> DataFrame:
        """Items of active tasks that hold a permit and are due, and queued ones in the permits left.

        Queued ones come by priority, the highest first, then by arrival. A late one of a high priority
        overtakes those that wait, never one that holds a permit.
        """
        items = self.store.table("items").where(F.col("state").isin("queued", "processing", "retrying"))
        tasks = self.store.table("tasks").where(F.col("state").isin(*lifecycle.ACTIVE)).select("task_id", "created_at")
        keyed = items.join(tasks, "task_id").withColumn("item", F.struct(*KEYS))
        holding = F.col("state") != "queued"
        if self.slots:
            keyed = self._kept(keyed)
            free = max(0, self.slots - keyed.where(holding).count())
            queued = keyed.where(~holding)
            ranked = queued.join(lifecycle.item_priorities(queued, self.engine.models), "item")
            first = ranked.orderBy(F.desc("priority"), "created_at", *KEYS).limit(free).drop("priority")
            keyed = keyed.where(holding).unionByName(first.select(*keyed.columns))
        keyed = keyed.where((F.col("state") != "retrying") | F.coalesce(F.col("retry_at") <= self._now(), F.lit(True))).drop("item")
        kind = modality(F.col("input.kind"), F.col("input.video"))
        return self._kept(keyed.select(*KEYS, "input", "models", "pipeline", F.coalesce("retries", F.lit(0)).cast("int").alias("retries"), kind.alias("modality"), input_url(F.col("input.kind"), F.col("input.main")).alias("url")))

    def _wanted(self, waiting: DataFrame) -> DataFrame:
        """(keys, model, step, state, output, ...): requested models with what an earlier pass stored."""
        stored = self.store.table("model_results").select("task_id", F.col("item_idx").alias("idx"), F.col("label").alias("model"), "state", "output")
        step = F.when(F.col("pipeline").isNull(), 0).otherwise(F.col("pos"))
        each = waiting.select(*KEYS, "pipeline", "modality", "url", F.posexplode("models").alias("pos", "model")).select("*", step.alias("step")).drop("pos")
        each = each.join(stored, MODEL, "left").join(self.revisions, "model", "left")
        return each.withColumn("done", F.coalesce(model_done(F.col("state")), F.lit(False))).withColumn("revision", F.coalesce("revision", F.lit("")))

    def _already_done(self, waiting: DataFrame, wanted: DataFrame) -> DataFrame:
        """Items whose models an earlier pass finished: they end without being fetched again."""
        return self._kept(wanted.groupBy(*KEYS).agg(F.bool_and("done").alias("all")).where("all").select(*KEYS))

    def _from_url_cache(self, waiting: DataFrame, wanted: DataFrame) -> DataFrame:
        """Items all of whose open models have a fresh output by their URL; pipelines never, as gates see every step."""
        open_ = wanted.where("pipeline is null and not done and url is not null")
        asked = open_.select(F.struct(*KEYS).alias("item"), caches.url_key(F.col("url")).alias("url_hash"), "model", "revision")
        asked = self._kept(asked)
        known = self._kept(self.store.table("url_cache", asked.select("url_hash")))
        hits = caches.url_cache_hits(asked, known, self.store.table("cache", known.select("content_hash")), self._fresh())
        hits = self._kept(hits.select("item.*", "model", "output"))
        self._results(hits, "done")
        return hits.select(*KEYS).distinct()

    # --- fetching

    def _fetched(self, items: DataFrame) -> tuple[DataFrame, DataFrame | None, float]:
        """(what was fetched and probed, what is to be tried again or None, when). The rest is out of retries and failed.

        The first has content, info, hash and retries, the second the seconds it has to wait (`_pause`).
        """
        tried = self._kept(self._fetch_once(items))
        at = time.monotonic()
        failed = tried.where("fetch_error is not null")
        self._fail_items(failed.where(F.col("retries") >= self.retries).select(*KEYS, _error("fetch", F.col("fetch_error")).alias("error")))
        again = failed.where(F.col("retries") < self.retries).withColumn("retries", F.col("retries") + 1).withColumn("_pause", retry_backoff(F.col("retries")).cast("double"))
        hashed = content_digest(F.col("content")) if self.cache else F.lit(None).cast("string")
        good = tried.where("fetch_error is null").select(*KEYS, "content", "info", "retries", hashed.alias("hash"))
        if again.isEmpty():
            return good, None, at
        due = (self._now() + F.ceil("_pause")).cast("long")
        self._append("items", again.select(*KEYS, F.col("retries").cast("long").alias("retries"), _error("fetch", F.col("fetch_error")).alias("error"), due.alias("retry_at")), state=F.lit("retrying"), set_error=F.lit(True))
        self._tell(again.select(*KEYS, F.lit("retrying").alias("state")))
        return good, again.drop("content", "fetch_error", "info"), at

    def _fetch_once(self, items: DataFrame) -> DataFrame:
        where = items.withColumn("_main", F.coalesce("input.main", "input.path")).withColumn("_fallback", F.col("input.fallback"))
        where = where.withColumn("_upload", F.col("input.kind") == "bytes")
        got = media.fetch(where, self.download, self.limits, "_main", "_fallback", upload="_upload", check=self.check if self.check else None)
        got = media.probe_content(got.drop("_main", "_fallback", "_upload"), self.tool)
        problem = F.when(F.col("modality") == "video", F.coalesce("problem", F.when(media.too_long(F.col("info.duration"), self.most_seconds), F.lit(f"the video is over the {self.most_seconds}s limit"))))
        return got.withColumn("fetch_error", F.coalesce("fetch_error", problem)).drop("problem")

    # --- models and gates

    def _steps(self, fetched: DataFrame, wanted: DataFrame) -> DataFrame:
        """Runs all models, pipelines position by position; gives the items that end completed."""
        alive = fetched.select(*KEYS)
        last = max((len(p["steps"]) for p in self.config.data["pipelines"].values()), default=1)
        gates = self.config.gates(self.spark).withColumnRenamed("label", "model")
        for step in range(max(1, last)):
            rows = wanted.where(F.col("step") == step).join(alive, KEYS, "left_semi")
            if step and rows.isEmpty():
                break
            rows = self._not_cancelled(rows)
            new = self._new_outputs(fetched, rows.where("not done").drop("output", "state"))
            failed = new.where("error is not null")
            stopped = failed.where("pipeline is not null").select(*KEYS, "error")
            self._results(new.where("error is null").select(*MODEL, "output"), "done")
            self._results(failed.select(*MODEL, "error"), "failed")
            self._fail_items(stopped)
            outputs = new.where("error is null").select(*MODEL, "pipeline", "output").unionByName(rows.where("done and output is not null").select(*MODEL, "pipeline", "output"))
            preds = F.coalesce(F.col("output.classification"), F.col("output.frame_scan.aggregated"))
            hit = F.exists(preds, lambda p: F.array_contains(F.col("stop_labels"), p["label"]) & (p["score"] >= F.col("stop_threshold").cast("float")))
            fired = self._kept(outputs.join(gates, ["pipeline", "model"]).where(F.coalesce(hit, F.lit(False))).select(*KEYS).distinct())
            later = wanted.where((F.col("step") > step) & ~F.coalesce(F.col("state") == "done", F.lit(False))).join(fired, KEYS, "left_semi")
            self._results(later.select(*MODEL), "skipped")
            # items that a gate ended are complete: they leave the loop but not the outcome
            wanted = self._kept(wanted.join(fired, KEYS, "left_anti"))
            alive = self._kept(alive.join(stopped, KEYS, "left_anti"))
        return alive

    def _new_outputs(self, fetched: DataFrame, todo: DataFrame) -> DataFrame:
        """(keys, model, pipeline, output, error) of open models: from the content cache, else by running them.

        A failed step of a pipeline is tried again as often as its item has retries left.
        """
        # contents stay where they were fetched to: a model's own plan joins them
        rows = todo.join(fetched.drop("content"), KEYS).withColumnRenamed("hash", "content_hash")
        if self.cache:
            rows = caches.content_cache(rows, self.store.table("cache", rows.select("content_hash")), self._fresh())
        else:
            rows = rows.withColumn("output", F.lit(None).cast(OUTPUT))
        rows = self._kept(rows)
        hits = rows.where("output is not null")
        left, out, attempt = rows.where("output is null").drop("output"), None, 0
        self._append("model_results", left.select("task_id", F.col("idx").alias("item_idx"), F.col("model").alias("label")), state=F.lit("processing"), set_output=F.lit(True))
        while True:
            new = self._kept(left.join(self._run_models(left, fetched.select(*KEYS, "content")), MODEL))
            again = new.where(F.col("error").isNotNull() & F.col("pipeline").isNotNull() & (F.col("retries") < self.retries))
            ended = new.join(again, MODEL, "left_anti") if attempt < self.retries else new
            out = ended if out is None else out.unionByName(ended)
            if again.isEmpty() or attempt >= self.retries:
                break
            again = again.withColumn("retries", F.col("retries") + 1)
            self._append("items", again.select(*KEYS, F.col("retries").cast("long").alias("retries")))
            attempt += 1
            self.wait(min(2 ** (attempt - 1), 30))
            left = self._not_cancelled(again.drop("output", "error"))
        if self.cache:
            fresh = out.where("output is not null")
            now = self._now()
            self.store.append("cache", fresh.select("content_hash", "model", "revision", "output", now.alias("created_at")))
            known = fresh.select("url", "model", "revision", "content_hash").union(hits.select("url", "model", "revision", "content_hash")).where("url is not null")
            self.store.append("url_cache", known.select(caches.url_key(F.col("url")).alias("url_hash"), "model", "revision", "content_hash", now.alias("created_at")).distinct())
        columns = [*MODEL, "pipeline", F.col("output").cast(OUTPUT).alias("output")]
        none = F.lit(None).cast("struct<kind:string,message:string>")
        return self._kept(hits.select(*columns, none.alias("error")).unionByName(out.select(*columns, "error")))

    def _run_models(self, rows: DataFrame, contents: DataFrame) -> DataFrame:
        """(keys, model, output, error) of rows (keys, model, modality, info) and the contents (keys, content)."""
        parts = [self._unknown(rows)]
        there = {tuple(r) for r in rows.select("model", "modality").distinct().collect()}  # of the configured models
        for name, settings in self.config.data["models"].items():
            if name not in self.models or not there & {(name, "image"), (name, "video")}:
                continue
            mine = rows.where(F.col("model") == name)
            model = classify.batch_model(self.models[name], settings["batch_size"], name, settings["revision"], settings["timeout_seconds"], self.config.head(name), self.config.data["server"]["idle_unload_seconds"])
            if (name, "image") in there:
                parts.append(self._images(mine.where("modality = 'image'").join(contents, KEYS), model))
            if (name, "video") in there:
                parts.append(self._videos(mine.where("modality = 'video'"), contents, model, settings))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _unknown(self, rows: DataFrame) -> DataFrame:
        known = [m for m in self.config.data["models"] if m in self.models]
        lost = rows.where(~F.col("model").isin(*known) | ~F.col("modality").isin("image", "video"))
        return lost.select(*MODEL, F.lit(None).cast(OUTPUT).alias("output"), _error("model_unavailable", F.concat(F.lit("no such model is loaded: "), "model")).alias("error"))

    def _images(self, rows: DataFrame, model) -> DataFrame:
        """The model selects from its scores in the worker: no score becomes a row."""
        scored = rows.select(*MODEL, model(F.col("content")).alias("r")).select(*MODEL, "r.*")
        output = F.when(F.col("error").isNull(), F.struct("classification", F.lit(None).alias("frame_scan")).cast(OUTPUT))
        return scored.select(*MODEL, output.alias("output"), F.when(F.col("error").isNotNull(), _error("inference", F.col("error"))).alias("error"))

    def _videos(self, rows: DataFrame, contents: DataFrame, model, settings: dict) -> DataFrame:
        """Sampled frames of each video through the model, as far as the first trigger; stored frames are not run again.

        Rounds over all scans: each gets some batches more than in the round before and stops inside a
        round as soon as it ends; its frames are stored before the next round, and cancelled tasks leave
        between rounds. A pass that dies loses one round, and the next one asks for the rest.
        """
        name = settings["strategy"]
        strategy = self.config.data["strategies"].get(name, {"steps": []})
        steps = self.config.steps(self.spark).where(F.col("strategy") == F.lit(name))
        videos = rows.select(*MODEL, F.lit(name).alias("strategy"), F.col("info.duration").alias("duration"), F.col("info.fps").alias("fps"))
        if any(s["method"] in ("iframes", "scene") for s in strategy["steps"]):
            videos = media.probe_steps(videos.join(contents, KEYS), strategy["steps"], self.tool).drop("content")
        else:
            videos = media.probe_steps(videos, [], self.tool)
        mine = lambda: self.store.table("frames").withColumnsRenamed({"item_idx": "idx", "label": "model"}).join(rows.select(*MODEL), MODEL, "left_semi")
        planned = classify.frame_plan(videos, steps, MODEL)
        pending = pool.pending(planned, mine().withColumn("frame_index", F.col("frame_index").cast("int")), [*MODEL, "frame_index"])
        left = self._kept(pending.groupBy(*MODEL).agg(F.array_sort(F.collect_list(F.struct("frame_index", "timestamp"))).alias("times")))
        labels = settings["labels"] if strategy.get("early_exit") else None
        errors, batches = None, 1
        while not left.isEmpty():
            n = batches * settings["batch_size"]
            now = self._not_cancelled(left.withColumn("times", F.slice("times", 1, n))).join(contents, KEYS)
            seen = self._kept(classify.scan_lazily(now, MODEL, model, labels, settings["trigger_threshold"], self.tool))
            self.store.append("frames", seen.where("error is null").select("task_id", F.col("idx").alias("item_idx"), F.col("model").alias("label"), "frame_index", "timestamp", "classification"))
            failed = seen.where("error is not null").select(*MODEL, "error")
            errors = failed if errors is None else errors.unionByName(failed)
            over = seen.where("fires or error is not null").select(*MODEL)
            rest = left.where(F.size("times") > n).join(over, MODEL, "left_anti").withColumn("times", F.slice("times", F.lit(n + 1), F.size("times")))
            left, batches = self._kept(self._not_cancelled(rest)), min(4 * batches, self.most_batches)
        scans = classify.assembled_scans(mine(), MODEL, strategy.get("aggregation", "mean"))
        none = F.struct(F.lit(None).cast(_PREDS).alias("classification"), F.struct(F.array().cast(_PREDS).alias("aggregated"), F.array().cast(f"array<struct<frame_index:bigint,timestamp:double,classification:{_PREDS}>>").alias("frames")).alias("frame_scan")).cast(OUTPUT)
        output = F.when(F.col("frame_scan").isNotNull(), F.struct(F.lit(None).alias("classification"), "frame_scan").cast(OUTPUT)).otherwise(none)
        joined = rows.select(*MODEL).join(scans, MODEL, "left")
        joined = joined.withColumn("error", F.lit(None).cast("string")) if errors is None else joined.join(errors, MODEL, "left")
        return joined.select(*MODEL, F.when(F.col("error").isNull(), output).alias("output"), F.when(F.col("error").isNotNull(), _error("inference", F.col("error"))).alias("error"))

    # --- states

    def _now(self):
        return F.lit(self.store.now()).cast("long")

    def _fresh(self) -> int:
        return caches.fresh_after(self.store.now(), self.ttl)

    def _kept(self, rows: DataFrame) -> DataFrame:
        """Rows written once: what a model or a download gave must not be asked for again."""
        return self.store.durable(rows)

    def _append(self, name: str, rows: DataFrame, **columns) -> None:
        self.store.append(name, rows.withColumns(columns) if columns else rows)

    def _tell(self, rows: DataFrame) -> None:
        if self.notify:
            outbox(rows, self.notify, (0,)).write.format("noop").mode("overwrite").save()

    def _results(self, rows: DataFrame, state: str) -> None:
        self._append("model_results", rows.withColumnsRenamed({"idx": "item_idx", "model": "label"}), state=F.lit(state), set_output=F.lit(True))

    def _fail_items(self, rows: DataFrame) -> None:
        """Items (keys, error) fail with all their models that are not done."""
        rows = self._kept(rows.dropDuplicates(KEYS))
        items = self.store.table("items").join(rows.select(*KEYS), KEYS, "left_semi").select(*KEYS, F.explode("models").alias("model"))
        done = self.store.table("model_results").where(model_done(F.col("state"))).select("task_id", F.col("item_idx").alias("idx"), F.col("label").alias("model"))
        self._results(items.join(done, MODEL, "left_anti").join(rows, KEYS), "failed")
        self._append("items", rows, state=F.lit("failed"), set_error=F.lit(True))

    def _not_cancelled(self, rows: DataFrame) -> DataFrame:
        gone = self.store.table("tasks").where("state = 'cancelled'").select("task_id")
        return rows.join(gone, "task_id", "left_anti")

    def _clean_uploads(self, waiting: DataFrame) -> None:
        """Staged files of tasks that have ended go, wherever the rows lie; a missing file is no error."""
        ended = self.store.table("tasks").where(F.col("state").isin("completed", "failed", "cancelled")).select("task_id")
        media.remove_files(waiting.where("input.kind = 'bytes' and input.path is not null").join(ended, "task_id", "left_semi").select(F.col("input.path").alias("path")))
