"""Streaming: early exit with keyed state, the delivery outbox, submissions, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _UntilTrigger(StatefulProcessor):
    """Frames of a key pass until one fires, which still passes; the state is one flag a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.over = handle.getValueState("over", "over boolean")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        over = self.over.exists() and self.over.get()[0]
        frames = [] if over else list(rows)
        if over or not frames:
            return
        frame = pd.concat(frames).sort_values("frame_index", kind="stable")
        hit = frame["fires"].to_numpy().nonzero()[0]
        if len(hit):
            frame = frame.iloc[: hit[0] + 1]
            self.over.update((True,))
        yield frame.drop(columns="fires")

    def close(self) -> None:
        pass


def stream_until_trigger(frames: DataFrame, key: str, fires) -> DataFrame:
    """A stream of frames, each key's cut after its first firing frame, however frames are batched.

    Frames of a key must come in index order over batches; within a batch they are sorted here.
    """
    schema = frames.schema
    marked = frames.withColumn("fires", F.coalesce(fires, F.lit(False)))
    return marked.groupBy(key).transformWithStateInPandas(statefulProcessor=_UntilTrigger(), outputStructType=schema, outputMode="Append", timeMode="None")


def outbox(pending: DataFrame, deliver: Callable[[dict], None], waits: tuple[float, ...] = (0, 1, 3)):
    """Deliver rows on the executors, each tried at the given waits; gives (keys, delivered) of the rows.

    At least once: a row counts as delivered only when `deliver` returned. Rows that fail stay pending.
    """
    import time

    import pandas as pd
    from pyspark.sql import types as T

    columns = pending.columns
    schema = T.StructType([*pending.schema.fields, T.StructField("delivered", T.BooleanType())])

    def run(frames):
        for frame in frames:
            done = []
            for row in frame.to_dict("records"):
                ok = False
                for wait in waits:
                    time.sleep(wait)
                    try:
                        deliver({c: row[c] for c in columns})
                        ok = True
                        break
                    except Exception:
                        continue
                done.append(ok)
            yield frame.assign(delivered=pd.Series(done, index=frame.index, dtype=bool))

    return pending.mapInPandas(run, schema)


def start_outbox(changes: DataFrame, store, deliver: Callable[[dict], None], checkpoint: str, waits: tuple[float, ...] = (0, 1, 3), seconds: int = 30):
    """Redeliver pending items of the store on every trigger; `changes` is any stream that ticks."""

    def batch(_: DataFrame, __: int) -> None:
        pending = store.items_pending_webhook().select("task_id", "idx", "state")
        sent = outbox(pending, deliver, waits).where("delivered").cache()
        store.append("items", sent.select("task_id", "idx", F.lit(True).alias("webhook_delivered")))
        sent.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def verified(deliveries: DataFrame, secret: str | None, task: str = "task_id", signature: str = "signature") -> DataFrame:
    """Add `problem` to received deliveries: a signature that is missing, malformed or not the task id's; null if it is right.

    Without a secret nothing is checked.
    """
    from ..functions.exprs import hex_decode, signature_matches

    if secret is None:
        return deliveries.withColumn("problem", F.lit(None).cast("string"))
    given = F.col(signature)
    problem = F.when(given.isNull(), "missing signature").when(hex_decode(F.regexp_replace(given, "^sha256=", "")).isNull(), "malformed signature").when(~signature_matches(secret, F.col(task), given), "invalid signature")
    return deliveries.withColumn("problem", problem)


def start_receiver(deliveries: DataFrame, secret: str | None, handle: Callable[[DataFrame], None], checkpoint: str, **trigger):
    """A stream of deliveries: `handle` gets each micro-batch's rows whose signatures are right; the others never reach it."""

    def batch(rows: DataFrame, _: int) -> None:
        handle(verified(rows, secret).where("problem is null").drop("problem"))

    return deliveries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def once(deliveries: DataFrame, keys: list[str], time_column: str, within: str = "1 day") -> DataFrame:
    """A receiver's view of at-least-once deliveries: repeats within the watermark drop."""
    return deliveries.withWatermark(time_column, within).dropDuplicatesWithinWatermark(keys)


def start_submissions(submissions: DataFrame, engine, checkpoint: str, **trigger):
    """A stream of submissions into the engine, a micro-batch at a time."""

    def batch(rows: DataFrame, _: int) -> None:
        engine.submit(rows)

    return submissions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time_column: str, keys: list[str], size: str, late: str) -> DataFrame:
    """Counts per tumbling window; events later than `late` behind the newest are left out. NTZ times count as UTC."""
    timed = events.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, late)
    return timed.groupBy(F.window(time_column, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def start_retention(ticks: DataFrame, store, keep_seconds: int, checkpoint: str, hours: int = 1):
    """Purge finished tasks older than `keep_seconds` on every trigger; the first is at once."""

    def batch(_: DataFrame, __: int) -> None:
        store.purge_finished_before(store.now() - keep_seconds)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{hours} hours").start()
