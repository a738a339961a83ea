"""Work that runs by itself: streams that admit, run, deliver and try again what the store holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import outbox, start_submissions


class Service:
    """An engine's streams: submissions into the store, and passes over it.

    Every tick is one pass of the runner without lingering, so a failing source holds up nobody: items hold
    their permits in the store from admission to their end, queued ones get what is free by priority and
    arrival, and those in back-off are taken by the first pass after it. Ended items are delivered after
    the pass; what could not be delivered is tried again on the next tick.

    All that outlives a tick is in the store's logs, so a service that died is started anew on the same
    folder and goes on.
    """

    def __init__(self, runner, folder: str, deliver: Callable[[dict], None] | None = None, waits: tuple[float, ...] = (0,)):
        self.runner, self.folder, self.deliver, self.waits = runner, folder, deliver, waits
        self.queries: list = []

    def start(self, submissions: DataFrame, seconds: float = 1.0) -> Service:
        """Begin with a stream of submissions (task_id, idx, input, models, pipeline); a tick every `seconds`."""
        spark: SparkSession = self.runner.spark
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        every = {"processingTime": f"{int(seconds * 1000)} milliseconds"}
        self.queries.append(start_submissions(submissions, self.runner.engine, f"{self.folder}/submissions", **every))
        self.queries.append(ticks.writeStream.foreachBatch(self._tick).option("checkpointLocation", f"{self.folder}/ticks").trigger(**every).start())
        return self

    def _tick(self, _: DataFrame, __: int) -> None:
        self.runner.run(linger=False)
        if self.deliver:
            store = self.runner.store
            sent = store.durable(outbox(store.items_pending_webhook().select("task_id", "idx", "state"), self.deliver, self.waits).where("delivered"))
            store.append("items", sent.select("task_id", "idx", F.lit(True).alias("webhook_delivered")))

    def problem(self) -> str | None:
        """What ended a stream, if any has failed."""
        failed = [str(q.exception()) for q in self.queries if q.exception() is not None]
        return failed[0] if failed else None

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
