"""Deliveries as a data source: a sink for batches and streams whose commit alone says what was delivered.

    spark.dataSource.register(DeliverySink)
    pending.write.format("deliveries").mode("append").options(to="package.module:function", log="/shared/delivered").save()
    store.take_delivered("/shared/delivered")

Tasks deliver their rows and report the keys; the driver writes these to the log when the whole write is
committed. A write that dies in the middle leaves no trace there, so its rows are delivered again: at
least once, and nothing is marked early.
"""

from __future__ import annotations

import hashlib
import hmac
import importlib
import json
import os
import time
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Delivered(WriterCommitMessage):
    """The keys (task_id, idx) that one task delivered, and how many rows it could not."""

    keys: list[tuple[str, int]]
    failed: int


def post(row: dict, url: str, secret: str | None = None, seconds: float = 10.0) -> None:
    """POST a row as JSON, signed by the task's id if there is a secret; anything but a 2xx answer raises."""
    headers = {"Content-Type": "application/json"}
    if secret:
        headers["X-Signature"] = "sha256=" + hmac.new(secret.encode(), row["task_id"].encode(), hashlib.sha256).hexdigest()
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(row, default=str).encode(), headers), timeout=seconds) as answer:
        if not 200 <= answer.status < 300:
            raise OSError(f"status {answer.status}")


class _Write:
    """What both writers share. `options`: to, or url and secret; waits, seconds before each try; log, a shared folder."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.waits = [float(w) for w in self.options.get("waits", "0,1,3").split(",")]

    def _deliver(self):
        if "to" in self.options:
            module, _, name = self.options["to"].partition(":")
            return getattr(importlib.import_module(module), name)
        return lambda row: post(row, self.options["url"], self.options.get("secret"))

    def write(self, iterator: Iterator) -> Delivered:
        deliver, keys, failed = self._deliver(), [], 0
        for row in iterator:
            row = row.asDict(True)
            for wait in self.waits:
                time.sleep(wait)
                try:
                    deliver(row)
                    keys.append((row["task_id"], row["idx"]))
                    break
                except Exception:
                    continue
            else:
                failed += 1
        return Delivered(keys, failed)

    def _note(self, messages: list, name: str) -> None:
        keys = [k for m in messages if m is not None for k in m.keys]
        if keys:
            os.makedirs(self.options["log"], exist_ok=True)
            part = os.path.join(self.options["log"], f".{uuid.uuid4()}")
            with open(part, "w", encoding="utf-8") as f:
                f.writelines(json.dumps({"task_id": t, "idx": i}) + "\n" for t, i in keys)
            os.replace(part, os.path.join(self.options["log"], f"{name}.json"))


class _BatchWrite(_Write, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._note(messages, str(uuid.uuid4()))


class _StreamWrite(_Write, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._note(messages, f"batch-{batchId}")  # a batch that runs again replaces its own note

    def abort(self, messages: list, batchId: int) -> None:
        pass


class DeliverySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "deliveries"

    def schema(self) -> str:
        return "task_id string, idx bigint, state string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchWrite(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWrite(self.options)
