"""The task store: append-only Parquet logs in shared storage, and the current tables derived from them.

Every change is a row with a version (nanoseconds, and a position within a batch); current values are
the newest per key, column by column where changes set some columns only. Nothing is updated in place,
so a lost executor loses no change, and readers see whole appends.

A log lies in `<table>/tail/_day=<n>` (the day of the versions) and, once compacted, in `<table>/base-<v>`:
the current rows of the files that the base lists in `<table>/base-<v>/_files`. Readers take the newest finished
base and the tail files that it does not list, so a compaction that fails changes nothing, and an append
that began before it and ends after it is read like any other: which files a base holds is told by
their names, not by their versions.
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import durable
from ..operators import lifecycle

_ERROR = "struct<kind:string,message:string>"
_PREDS = "array<struct<label:bigint,score:float>>"
_OUTPUT = f"struct<classification:{_PREDS},frame_scan:struct<aggregated:{_PREDS},frames:array<struct<frame_index:bigint,timestamp:double,classification:{_PREDS}>>>>"
_INPUT = "struct<kind:string,main:string,fallback:string,text:string,path:string,video:boolean>"
#: Per table its key and columns. A null column of a change leaves the value as it was; `set_*` flags say otherwise.
TABLES = {
    "tasks": (["task_id"], "task_id string, state string, attempts bigint, created_at bigint, updated_at bigint"),
    "items": (["task_id", "idx"], f"task_id string, idx bigint, input {_INPUT}, models array<string>, pipeline string, state string, error {_ERROR}, set_error boolean, webhook_delivered boolean, retries bigint, retry_at bigint"),
    "model_results": (["task_id", "item_idx", "label"], f"task_id string, item_idx bigint, label string, state string, output {_OUTPUT}, set_output boolean, error {_ERROR}, steps_completed bigint, default_state string"),
    "frames": (["task_id", "item_idx", "label", "frame_index"], f"task_id string, item_idx bigint, label string, frame_index bigint, timestamp double, classification {_PREDS}"),
    "cache": (["content_hash", "model", "revision"], f"content_hash string, model string, revision string, output {_OUTPUT}, created_at bigint"),
    "url_cache": (["url_hash", "model", "revision"], "url_hash string, model string, revision string, content_hash string, created_at bigint"),
}

#: Tables whose bases lie in folders by a hash of this key, so that a lookup reads those of its keys, and how many.
BUCKETED, BUCKETS = {"cache": "content_hash", "url_cache": "url_hash"}, 256
#: By which columns the rows of a large log are parted: those of a key together, and of a result its frames.
PARTED = {"tasks": ["task_id"], "items": ["task_id", "idx"], "model_results": ["task_id", "item_idx", "label"], "frames": ["task_id", "item_idx", "label"], "cache": ["content_hash", "model", "revision"], "url_cache": ["url_hash", "model", "revision"]}
#: Bytes of log files that one task reads, and whose rows it sorts by key; in memory they are some twenty times as many.
PART_BYTES = 4 << 20
#: Bytes of a base count so often: sorted by key, its rows take the fewer.
BASE_WEIGHT = 2
#: Nanoseconds of a day, by which tails are parted.
DAY = 86400 * 10**9


class Store:
    """`root` is a folder that all machines share. `now` gives UNIX seconds; tests pass their own."""

    def __init__(self, spark: SparkSession, root: str, now=lambda: int(time.time())):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now
        self._last, self._holding, self._held, self._sizes, self._parts = 0, 0, {}, {}, 0

    # --- logs

    def migrate(self) -> None:
        """Create missing logs; calling it again changes nothing."""
        for name in TABLES:
            if not self._exists(f"{self.root}/{name}/tail"):
                self._rows([], name).write.mode("append").parquet(self._tail(name, 0))
        if not self._exists(f"{self.root}/purged"):
            self.spark.createDataFrame([], "task_id string, _version bigint").write.mode("append").parquet(f"{self.root}/purged/_day=0")

    def _fs(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, path: str) -> bool:
        fs, path = self._fs(path)
        return fs.exists(path)

    def _tail(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/tail/_day={version // DAY}"

    def _bases(self, name: str) -> list[tuple[int, str]]:
        """(version, folder) of the bases that were written to their end, the newest first."""
        fs, path = self._fs(f"{self.root}/{name}")
        found = [(int(x.getPath().getName()[5:]), str(x.getPath())) for x in fs.listStatus(path) if x.getPath().getName().startswith("base-")]
        return sorted(((v, p) for v, p in found if self._exists(f"{p}/_files")), reverse=True)

    def _listed(self, base: str) -> set[str]:
        """The tail files whose rows a base holds."""
        fs, path = self._fs(f"{base}/_files")
        stream = fs.open(path)
        try:
            return set(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split())
        finally:
            stream.close()

    def _tail_files(self, name: str) -> list[str]:
        """Finished files of the tail as `_day=<n>/<file>`; those that are being written lie elsewhere."""
        fs, path = self._fs(f"{self.root}/{name}/tail")
        days = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("_day=")]
        found = []
        for d in days:
            day = d.getName()
            for x in fs.listStatus(d):
                file = f"{day}/{x.getPath().getName()}"
                if file.endswith(".parquet"):
                    found.append(file)
                    if (name, file) not in self._sizes:  # files never change
                        self._sizes[name, file] = x.getLen()
        return sorted(found)

    def durable(self, rows: DataFrame) -> DataFrame:
        """`rows` written once, to the folder that the session names for checkpoints or else below the store's root."""
        return durable(rows, f"{self.root}/_checkpoints")

    def _schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(TABLES[name][1] + ", _version bigint")

    def _version(self) -> int:
        self._last = max(self._last + 1, time.time_ns())
        return self._last

    def _rows(self, rows: list[dict], name: str) -> DataFrame:
        schema = self._schema(name)
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    def _append(self, name: str, *rows: dict) -> None:
        version = self._version()
        self._held.setdefault(name, []).extend(r | {"_version": version} for r in rows)
        if not self._holding:
            self._flush()

    def _flush(self) -> None:
        held, self._held = self._held, {}
        for name, rows in held.items():
            self._write(self._rows(rows, name), name, self._last)

    @contextmanager
    def batch(self):
        """Single changes made inside are written together at its end, a file a table; reads inside write them first."""
        self._holding += 1
        try:
            yield self
        finally:
            self._holding -= 1
            if not self._holding:
                self._flush()

    def _write(self, rows: DataFrame, name: str, version: int) -> None:
        key = TABLES[name][0][0]  # a filter on it skips files that lack the value
        rows.write.mode("append").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(self._tail(name, version))

    def append(self, name: str, rows: DataFrame) -> None:
        """Append many changes at once, in parallel; columns of the table that `rows` lacks are null."""
        version, have = self._version(), set(rows.columns)
        cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._schema(name) if f.name != "_version"]
        self._write(rows.select(*cols, F.lit(version).alias("_version")), name, version)

    def _folders(self, name: str, base: str, buckets: set[int] | None) -> list[str]:
        """The folders of a base that hold rows of these buckets; all without any."""
        if name not in BUCKETED:
            return [base]
        fs, path = self._fs(base)
        found = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("_bucket=")]
        return [str(p) for p in found if buckets is None or int(p.getName()[8:]) in buckets]

    def _sized(self, name: str, folder: str) -> list[tuple[str, int]]:
        """(path, bytes by weight) of a base's files; the folders of a cache stay whole."""
        fs, path = self._fs(folder)
        if name in BUCKETED:
            return [(folder, BASE_WEIGHT * fs.getContentSummary(path).getLength())]
        return [(str(x.getPath()), BASE_WEIGHT * x.getLen()) for x in fs.listStatus(path) if x.getPath().getName().endswith(".parquet")]

    def _scan(self, name: str, files: list[tuple[str, int]]) -> DataFrame:
        """Rows of log files (path, bytes). Spark deals the bytes of one read to its cores: large logs are several reads."""
        groups, most, room = [], PART_BYTES * self.spark.sparkContext.defaultParallelism, 0
        for path, size in files:
            if not groups or size > room:
                groups.append([])
                room = most
            groups[-1].append(path)
            room -= size
        schema = self._schema(name)
        reads = [self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*g) for g in groups]
        return reduce(DataFrame.union, reads) if reads else self.spark.createDataFrame([], schema)

    def _read(self, name: str, bases: list[tuple[int, str]], files: list[str], buckets: set[int] | None = None) -> tuple[DataFrame, int]:
        """The rows of the newest base and of tail files, without those of purged tasks, and in how many parts they are to be sorted."""
        sized = [x for f in (self._folders(name, bases[0][1], buckets) if bases else []) for x in self._sized(name, f)]
        sized += [(f"{self.root}/{name}/tail/{f}", self._sizes[name, f]) for f in files]
        log, parts = self._scan(name, sized), -(-sum(n for _, n in sized) // PART_BYTES)
        if name not in BUCKETED:  # tables of tasks are joined with each other: in as many parts as the largest so far
            self._parts = parts = max(self._parts, parts)
        # what was purged before the last base but one is in neither any more
        floor = bases[1][0] if len(bases) > 1 else -1
        if "task_id" in log.columns and self._purges(floor):
            purged = self.spark.read.schema("task_id string, _version bigint, _day bigint").option("basePath", f"{self.root}/purged").parquet(f"{self.root}/purged")
            purged = purged.where((F.col("_day") >= max(0, floor) // DAY) & (F.col("_version") > floor))
            purged = self._parted(purged, parts, ["task_id"]).groupBy("task_id").agg(F.max("_version").alias("_gone"))
            log = log.join(purged, "task_id", "left").where("_gone is null or _version > _gone").drop("_gone")
        return log, parts

    def _purges(self, floor: int) -> bool:
        """Whether anything was purged on the day of `floor` or later; day 0 stands for the table itself."""
        fs, folder = self._fs(f"{self.root}/purged")
        days = [x.getPath().getName().removeprefix("_day=") for x in fs.listStatus(folder)]
        return any(d.isdigit() and int(d) >= max(1, floor // DAY) for d in days)

    def _parted(self, rows: DataFrame, parts: int, columns: list[str]) -> DataFrame:
        """Rows of a log that is large for the cores in `parts` parts; Spark parts those of others by its own measure.

        Every part is sorted in one task: with a fixed number of them its memory would grow with the log.
        """
        return rows.repartition(parts, *columns) if parts > self.spark.sparkContext.defaultParallelism else rows

    @staticmethod
    def _bucket(name: str):
        return F.pmod(F.xxhash64(BUCKETED[name]), F.lit(BUCKETS)).cast("int")

    def _log(self, name: str, buckets: set[int] | None = None) -> tuple[DataFrame, int]:
        self._flush()
        bases = self._bases(name)
        held = self._listed(bases[0][1]) if bases else set()
        return self._read(name, bases, [f for f in self._tail_files(name) if f not in held], buckets)

    @staticmethod
    def _newest(column: str, when: str | None = None):
        """The newest value that was set: a null leaves the value, unless the change says that it sets null."""
        set_ = F.col(column).isNotNull() if when is None else F.coalesce(F.col(when), F.lit(False)) | F.col(column).isNotNull()
        return F.max_by(F.struct(F.col(column).alias("v")), F.when(set_, F.col("_version")))["v"].alias(column)

    def table(self, name: str, only: DataFrame | None = None) -> DataFrame:
        """The current rows. One aggregate by key; maxima combine before the shuffle.

        `only` has some key columns: rows of other keys are left out of the log as it is read, so that a
        lookup of few keys, which Spark then broadcasts, neither shuffles nor aggregates the rest. Of a
        cache's base it reads the folders of its keys only.
        """
        keys, _ = TABLES[name]
        buckets = None
        if only is not None and BUCKETED.get(name) in only.columns:
            buckets = {r[0] for r in only.select(self._bucket(name)).distinct().collect()}  # BUCKETS numbers at most
        log, parts = self._log(name, buckets)
        log = self._parted(log, parts, PARTED[name]) if only is None else log.join(only.distinct(), only.columns, "left_semi")
        sets = {"error": "set_error", "output": "set_output"}
        plain = [f.name for f in self._schema(name) if f.name not in keys and f.name != "_version" and not f.name.startswith("set_") and f.name != "default_state"]
        current = [self._newest(c, sets.get(c) if sets.get(c) in log.columns else "set_output" if c == "error" and name == "model_results" else None) for c in plain]
        if name == "tasks":
            current = [self._newest("state"), F.count(F.when(F.col("attempts") == 1, 1)).alias("attempts"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")]
        if name == "model_results":
            current = [F.coalesce(self._newest("state"), F.min_by("default_state", "_version")).alias("state") if c == "state" else x for c, x in zip(plain, current)]
        if name in ("frames", "cache", "url_cache"):  # rows are replaced as wholes
            current = [F.max_by(F.struct(*plain), "_version").alias("r")]
            return log.groupBy(*keys).agg(*current).select(*keys, "r.*")
        out = log.groupBy(*keys).agg(*current)
        if name == "items":
            out = out.where("state is not null").withColumn("webhook_delivered", F.coalesce("webhook_delivered", F.lit(False))).withColumn("retries", F.coalesce("retries", F.lit(0).cast("long")))
        if name == "model_results":
            out = out.withColumn("steps_completed", F.coalesce("steps_completed", F.lit(0).cast("long")))
        if name == "tasks":
            out = out.where("created_at is not null")
        return out

    def _telling(self, name: str, log: DataFrame) -> DataFrame:
        """The rows of a log that its current table depends on, as they are: per key and column the newest that sets it.

        Versions stay, so a change that turns up later finds its place among them.
        """
        keys, _ = TABLES[name]
        w = Window.partitionBy(*keys)
        if name in ("frames", "cache", "url_cache"):
            return log.withColumn("_top", F.max("_version").over(w)).where("_version = _top").drop("_top")
        columns = [f.name for f in self._schema(name) if f.name not in keys and f.name != "_version" and not f.name.startswith("set_")]
        tells = F.lit(False)
        for c in columns:
            flag = {"error": "set_error" if name == "items" else "set_output", "output": "set_output"}.get(c)
            sets = F.col(c).isNotNull() if flag is None else F.coalesce(F.col(flag), F.lit(False)) | F.col(c).isNotNull()
            if c in ("created_at", "default_state"):  # the first counts
                tells = tells | (sets & (F.col("_version") == F.min(F.when(sets, F.col("_version"))).over(w)))
                if c == "created_at":
                    tells = tells | (F.col(c) == F.min(c).over(w))
            elif c == "attempts":  # each is counted
                tells = tells | (F.coalesce(F.col(c), F.lit(0)) == 1)
            elif c == "updated_at":
                tells = tells | (F.col(c) == F.max(c).over(w)) & (F.col("_version") == F.max(F.when(F.col(c) == F.col("_updated"), F.col("_version"))).over(w))
            else:
                tells = tells | (sets & (F.col("_version") == F.max(F.when(sets, F.col("_version"))).over(w)))
        if "updated_at" in columns:
            log = log.withColumn("_updated", F.max("updated_at").over(w))
        return log.withColumn("_tells", F.coalesce(tells, F.lit(False))).where("_tells").drop("_tells", "_updated")

    def compact(self, name: str) -> None:
        """Write what the current rows depend on as a new base, and the names of the files that it stands for.

        A change whose file lands while this runs, however old its version, is in no listed file and stays
        in the tail. Files that the last base but one listed, older bases, and what was purged before
        them, go; readers that began with the last base keep all it needs.
        """
        self._flush()
        version, bases = self._version(), self._bases(name)
        held = self._listed(bases[0][1]) if bases else set()
        files = self._tail_files(name)
        log, parts = self._read(name, bases, [f for f in files if f not in held])
        rows = self._telling(name, self._parted(log, parts, PARTED[name]))
        keys, _ = TABLES[name]
        base = f"{self.root}/{name}/base-{version}"
        # sorted by key, so that footers tell which file may hold one
        if name in BUCKETED:
            rows.withColumn("_bucket", self._bucket(name)).repartition("_bucket").sortWithinPartitions("_bucket", *keys).write.mode("overwrite").partitionBy("_bucket").parquet(base)
        else:
            rows.sortWithinPartitions(*keys).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{keys[0]}", "true").parquet(base)
        fs, path = self._fs(f"{base}/_files.part")
        out = fs.create(path, True)
        out.write("\n".join(files).encode())
        out.close()
        fs.rename(path, self._fs(f"{base}/_files")[1])
        for f in held & set(files):
            fs.delete(self._fs(f"{self.root}/{name}/tail/{f}")[1], False)
        _, folder = self._fs(f"{self.root}/{name}")
        for x in fs.listStatus(folder):
            at = x.getPath().getName()
            if at.startswith("base-") and int(at[5:]) not in (version, *(v for v, _ in bases[:1])) and int(at[5:]) < version:
                fs.delete(x.getPath(), True)
        floors = [b[1][0] if len(b) > 1 else 0 for b in (self._bases(n) for n, (k, _) in TABLES.items() if "task_id" in k)]
        _, folder = self._fs(f"{self.root}/purged")
        for x in fs.listStatus(folder):
            day = x.getPath().getName().removeprefix("_day=")
            if day.isdigit() and 0 < int(day) < min(floors) // DAY:
                fs.delete(x.getPath(), True)

    # --- operations

    def create_task(self, task_id: str, items: list[dict]) -> None:
        now = self.now()
        self._append("items", *[{"task_id": task_id, "idx": i, "state": "queued", "retries": 0, "webhook_delivered": False} | item for i, item in enumerate(items)])
        self._append("tasks", {"task_id": task_id, "state": "queued", "attempts": 0, "created_at": now, "updated_at": now})  # last: a task shows when whole

    def create_tasks(self, items: DataFrame) -> None:
        """Many at once: rows (task_id, idx, input, models, pipeline)."""
        now = F.lit(self.now()).cast("long")
        queued, before = items.withColumn("state", F.lit("queued")), set(self._tail_files("items"))
        self.append("items", queued)
        parts = -(-sum(self._sizes["items", f] for f in self._tail_files("items") if f not in before) // PART_BYTES)
        tasks = self._parted(queued.select("task_id"), parts, ["task_id"]).distinct()
        self.append("tasks", tasks.select("task_id", F.lit("queued").alias("state"), F.lit(0).alias("attempts"), now.alias("created_at"), now.alias("updated_at")))

    def _touch(self, task_id: str, **columns) -> None:
        self._append("tasks", {"task_id": task_id, "updated_at": self.now()} | columns)

    def set_task_state(self, task_id: str, state: str) -> None:
        self._touch(task_id, state=state)

    def set_item_state(self, task_id: str, idx: int, state: str, error: dict | None = None) -> None:
        with self.batch():
            self._append("items", {"task_id": task_id, "idx": idx, "state": state, "error": error, "set_error": True})
            self._touch(task_id)

    def upsert_model_result(self, task_id: str, idx: int, label: str, state: str, output: dict | None = None, error: dict | None = None) -> None:
        """State, output and error as given; steps_completed stays."""
        with self.batch():
            self._append("model_results", {"task_id": task_id, "item_idx": idx, "label": label, "state": state, "output": output, "error": error, "set_output": True})
            self._touch(task_id)

    def append_frame(self, task_id: str, idx: int, label: str, frame_index: int, timestamp: float, classification: list) -> None:
        """A frame of the same index is replaced; the task is not touched."""
        self._append("frames", {"task_id": task_id, "item_idx": idx, "label": label, "frame_index": frame_index, "timestamp": timestamp, "classification": classification})

    def load_frames(self, task_id: str, idx: int, label: str) -> DataFrame:
        return self.table("frames").where((F.col("task_id") == task_id) & (F.col("item_idx") == idx) & (F.col("label") == label)).orderBy("frame_index")

    def set_steps_completed(self, task_id: str, idx: int, label: str, steps: int) -> None:
        """A new result begins as processing; a present one keeps its state."""
        self._append("model_results", {"task_id": task_id, "item_idx": idx, "label": label, "steps_completed": steps, "default_state": "processing"})

    def steps_completed(self, task_id: str, idx: int, label: str) -> int:
        row = self.table("model_results").where((F.col("task_id") == task_id) & (F.col("item_idx") == idx) & (F.col("label") == label)).first()
        return row["steps_completed"] if row else 0

    def increment_attempts(self, task_id: str) -> int:
        self._touch(task_id, attempts=1)
        return self.table("tasks").where(F.col("task_id") == task_id).first()["attempts"]

    def rolled_up(self, touched: DataFrame | None = None) -> DataFrame:
        """Tasks, or those of `touched`, with the states that follow from their items'; `_was` is the state before.

        Items are grouped, and joined with tasks, in the parts of the larger log.
        """
        items, tasks = self.table("items"), self.table("tasks")  # in this order: tasks come in the parts of items
        items = self._parted(items.select("task_id", "state"), self._parts, ["task_id"])
        if touched is not None:
            items, tasks = (x.join(touched, "task_id", "left_semi") for x in (items, tasks))
        return lifecycle.roll_up(tasks.withColumn("_was", F.col("state")), items)

    def load_incomplete_tasks(self) -> DataFrame:
        return lifecycle.incomplete(self.table("tasks"))

    def items_pending_webhook(self) -> DataFrame:
        return lifecycle.pending_deliveries(self.table("items"))

    def mark_webhook_delivered(self, task_id: str, idx: int) -> None:
        self._append("items", {"task_id": task_id, "idx": idx, "webhook_delivered": True})

    def take_delivered(self, log: str) -> int:
        """Mark what a delivery sink committed to its log, and clear the files taken; gives how many items.

        Files go after their items are marked, so a driver that is lost between marks them again.
        """
        fs, folder = self._fs(log)
        files = [str(x.getPath()) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json")] if fs.exists(folder) else []
        if not files:
            return 0
        rows = self.durable(self.spark.read.schema("task_id string, idx bigint").json(files).distinct())
        self.append("items", rows.withColumn("webhook_delivered", F.lit(True)))
        for f in files:
            fs.delete(self._fs(f)[1], False)
        return rows.count()

    def set_item_retries(self, task_id: str, idx: int, retries: int) -> None:
        self._append("items", {"task_id": task_id, "idx": idx, "retries": retries})

    def purge_finished_before(self, cutoff: int) -> int:
        """Finished tasks last touched before the cutoff go, with all their rows; gives how many."""
        gone = lifecycle.expired(self.table("tasks"), cutoff).select("task_id", F.lit(self._version()).alias("_version")).cache()
        try:
            n = gone.count()
            gone.write.mode("append").parquet(f"{self.root}/purged/_day={self._last // DAY}")
        finally:
            gone.unpersist()
        return n

    def cache_store(self, content_hash: str, model: str, revision: str, output: dict) -> None:
        self._append("cache", {"content_hash": content_hash, "model": model, "revision": revision, "output": output, "created_at": self.now()})

    def cache_lookup(self, content_hash: str, model: str, revision: str, fresh_after: int = 0):
        row = self.table("cache").where((F.col("content_hash") == content_hash) & (F.col("model") == model) & (F.col("revision") == revision) & (F.col("created_at") >= fresh_after)).first()
        return row["output"] if row else None

    def url_cache_store(self, url_hash: str, model: str, revision: str, content_hash: str) -> None:
        self._append("url_cache", {"url_hash": url_hash, "model": model, "revision": revision, "content_hash": content_hash, "created_at": self.now()})

    def url_cache_lookup(self, url_hash: str, model: str, revision: str, fresh_after: int = 0) -> str | None:
        row = self.table("url_cache").where((F.col("url_hash") == url_hash) & (F.col("model") == model) & (F.col("revision") == revision) & (F.col("created_at") >= fresh_after)).first()
        return row["content_hash"] if row else None

    def get_task(self, task_id: str) -> DataFrame:
        """Items of a task with every requested model, queued until it has a result; stored others stay."""
        mine = F.col("task_id") == task_id
        items = self.table("items").where(mine)
        wanted = items.select("task_id", F.col("idx").alias("item_idx"), F.explode("models").alias("label"))
        results = lifecycle.result_overlay(wanted, self.table("model_results").where(mine), ["task_id", "item_idx", "label"])
        packed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("state", "output", "error", "steps_completed")))))
        by_item = results.groupBy("task_id", F.col("item_idx").alias("idx")).agg(packed.alias("results"))
        return items.join(by_item, ["task_id", "idx"], "left").orderBy("idx")


def open_store(spark: SparkSession, backend: str, root: str, **how) -> Store:
    """The store of a configured backend, migrated. Parquet only; others name databases this engine has no driver for."""
    if backend not in ("parquet", "file"):
        raise ValueError(f"unsupported backend: {backend}")
    store = Store(spark, root, **how)
    store.migrate()
    return store


__all__ = ["Store", "TABLES", "open_store"]
