"""Uploads that arrive as streams of messages: keyed state until the last one, a running cap, expiry by timers."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Messages: `kind` is init, data or end; `seq` orders those of an upload.
MESSAGES = "upload_id string, seq bigint, kind string, video boolean, models array<string>, pipeline string, data binary"
RESULT = "upload_id string, problem string, video boolean, models array<string>, pipeline string, data binary"


class _Uploads(StatefulProcessor):
    """One upload's messages: the description, the parts so far and their size.

    An upload that ended, well or not, is remembered as closed until its timer fires, so that what still
    arrives of it is dropped and does not begin it anew.
    """

    def __init__(self, most_bytes: int | None, expire_ms: int):
        self.most_bytes, self.expire_ms = most_bytes, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "video boolean, models string, pipeline string, received bigint, closed boolean")
        self.parts = handle.getListState("parts", "data binary")

    def _close(self, key, told, problem=None):
        import json

        import pandas as pd

        data = None if problem else b"".join(bytes(p[0]) for p in self.parts.get())
        self.parts.clear()
        self.told.update((*told[:3], told[3], True))
        models = None if told[1] is None else json.loads(told[1])
        return pd.DataFrame([(key[0], problem, told[0], models, told[2], data)], columns=[c.split()[0] for c in RESULT.split(", ")])

    def _rearm(self, timer_values) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.expire_ms)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import json

        import pandas as pd

        frames = list(rows)
        if not frames:
            return
        told = tuple(self.told.get()) if self.told.exists() else None
        if told is not None and told[4]:
            return
        for m in pd.concat(frames).sort_values("seq", kind="stable").itertuples():
            if told is None:
                if m.kind != "init":
                    yield self._close(key, (None, None, None, 0), "the first message must describe the upload")
                    break
                models = [] if m.models is None else list(m.models)
                told = (bool(m.video), json.dumps(models), m.pipeline, 0, False)
                if not models and not m.pipeline:
                    yield self._close(key, told, "models or a pipeline are required")
                    break
            elif m.kind == "init":
                yield self._close(key, told, "the upload was described twice")
                break
            elif m.kind == "end":
                yield self._close(key, told, None if told[3] else "the upload is empty")
                break
            elif m.data is not None:
                received = told[3] + len(m.data)
                if self.most_bytes is not None and received > self.most_bytes:
                    yield self._close(key, told, "the upload is too large")
                    break
                self.parts.appendValue((bytes(m.data),))
                told = (*told[:3], received, False)
        else:
            self.told.update(told)
        self._rearm(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        told = tuple(self.told.get()) if self.told.exists() else None
        if told is not None and not told[4]:
            yield self._close(key, told, "the upload was not finished in time")
        self.told.clear()
        self.parts.clear()

    def close(self) -> None:
        pass


def uploads(messages: DataFrame, most_bytes: int | None = None, expire_seconds: float = 300) -> DataFrame:
    """(upload_id, problem, video, models, pipeline, data) of a stream of MESSAGES, once an upload ends.

    The first message must be `init`, no other may be; `data` adds up to the cap, beyond which the parts
    are dropped at once; `end` gives the bytes, which fit the cap. An upload that has been silent for
    `expire_seconds` ends as unfinished. Messages of an upload arrive in order over micro-batches and
    are sorted within one. Uploads are spread by id; the state holds the bytes of those that are open.
    """
    return messages.groupBy("upload_id").transformWithStateInPandas(statefulProcessor=_Uploads(most_bytes, int(expire_seconds * 1000)), outputStructType=T.StructType.fromDDL(RESULT), outputMode="Append", timeMode="ProcessingTime")


def staged(finished: DataFrame, folder: str) -> DataFrame:
    """Finished uploads with `path` in place of the bytes: files in a folder that all machines share, written by the tasks.

    A file is written under another name and renamed, so that a task tried again leaves a whole one.
    """
    import pandas as pd

    schema = T.StructType([f for f in finished.schema.fields if f.name != "data"] + [T.StructField("path", T.StringType())])

    def write(frames):
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            paths = []
            for name, data in zip(frame["upload_id"], frame["data"]):
                path = None
                if data is not None:
                    path = os.path.join(folder, f"{name}.bin")
                    part = f"{path}.{os.getpid()}"
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, path)
                paths.append(path)
            yield frame.drop(columns="data").assign(path=pd.Series(paths, index=frame.index, dtype=object))

    return finished.mapInPandas(write, schema)


def start_uploads(messages: DataFrame, engine, folder: str, checkpoint: str, most_bytes: int | None = None, expire_seconds: float = 300, refused=None, **trigger):
    """A stream of upload messages into the engine: each finished upload is staged and submitted as a task of its id.

    `refused(rows)` gets (upload_id, problem) of uploads that broke a rule and of those that the engine
    rejects; the files of the latter are removed, as no task will.
    """
    from ..sources import media

    def batch(rows: DataFrame, _: int) -> None:
        rows = engine.store.durable(staged(rows, folder))
        broken = rows.where("problem is not null").select("upload_id", "problem")
        kinds = F.struct(F.lit("bytes").alias("kind"), F.lit(None).cast("string").alias("main"), F.lit(None).cast("string").alias("fallback"), F.lit(None).cast("string").alias("text"), "path", "video")
        # a batch that runs again finds its tasks in the store
        fresh = rows.where("problem is null").join(engine.store.table("tasks").select(F.col("task_id").alias("upload_id")), "upload_id", "left_anti")
        work = fresh.select(F.col("upload_id").alias("task_id"), F.lit(0).cast("long").alias("idx"), kinds.alias("input"), F.coalesce("models", F.array().cast("array<string>")).alias("models"), "pipeline")
        _, rejected = engine.submit(work)
        rejected = rejected.select(F.col("task_id").alias("upload_id"), "problem")
        media.remove_files(rows.join(rejected, "upload_id", "left_semi").select("path"))
        if refused:
            refused(broken.unionByName(rejected))

    stream = uploads(messages, most_bytes, expire_seconds).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "1 second"})).start()


__all__ = ["MESSAGES", "RESULT", "staged", "start_uploads", "uploads"]
