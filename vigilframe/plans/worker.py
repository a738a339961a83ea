"""Models in Python workers: loaded when first asked, dropped when idle, asked in whole batches within a time limit."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import heads
from ..functions.timing import within

_PREDICTIONS = "array<struct<label:bigint,score:float>>"
RESULT = f"struct<classification:{_PREDICTIONS},error:string>"


class Resident:
    """What this process holds of models, by name and revision; one idle longer than it may be is dropped."""

    def __init__(self):
        self.lock, self.held, self.sweeper = threading.Lock(), {}, None

    def get(self, key, load: Callable, idle_seconds: float | None):
        """The loaded model. `idle_seconds` None keeps it for as long as the process lives."""
        with self.lock:
            if key not in self.held:
                self.held[key] = [load(), time.monotonic(), idle_seconds]
            self.held[key][1:] = [time.monotonic(), idle_seconds]
            if idle_seconds is not None and self.sweeper is None:
                self.sweeper = threading.Thread(target=self._sweep, daemon=True)
                self.sweeper.start()
            return self.held[key][0]

    def touch(self, key) -> None:
        with self.lock:
            if key in self.held:
                self.held[key][1] = time.monotonic()

    def _sweep(self) -> None:
        while True:
            with self.lock:
                now, waits = time.monotonic(), []
                for key, (_, used, idle) in list(self.held.items()):
                    if idle is not None and now - used >= idle:
                        del self.held[key]
                    elif idle is not None:
                        waits.append(idle - (now - used))
                if not waits:
                    self.sweeper = None
                    return
            time.sleep(max(0.01, min(waits)))


RESIDENT = Resident()


class Model:
    """A model that columns of images are put through: `model(column)` is struct(classification, error).

    `load()` gives a function of images, a `heads.Vit` or a `heads.Siglip`; `settings` say how its output
    is selected (see heads.predictor). It runs when a worker first needs the model, known by name and
    revision, and again after the weights were idle for `idle_seconds`.

    Batches of `batch_size` go on over Arrow batches: a task asks the model ceil(rows / batch_size) times.
    Null inputs are errors. A failing batch fails all its rows with the failure's text, and so does one
    that takes longer than `timeout_seconds`, which bounds the classification of each of its images.
    """

    def __init__(self, load: Callable, batch_size: int = 8, name: str | None = None, revision: str = "main", timeout_seconds: float | None = None, settings: dict | None = None, idle_seconds: float | None = 300):
        self.load, self.batch_size, self.name, self.revision = load, batch_size, name, revision
        self.timeout_seconds, self.settings, self.idle_seconds = timeout_seconds, settings, idle_seconds

    def _key(self):
        if self.name:
            return self.name, self.revision
        return self.load.__code__ if hasattr(self.load, "__code__") and not self.load.__closure__ else id(self.load)

    def ask(self, images: list) -> list[tuple[list | None, str | None]]:
        """(classification, error) of each image of one batch."""
        key = self._key()
        try:
            predict = RESIDENT.get(key, lambda: heads.predictor(self.load(), self.settings), self.idle_seconds)
            return [(x, None) for x in within(self.timeout_seconds, predict, images)]
        except TimeoutError:
            return [(None, f"model {self.name or 'without a name'} timed out")] * len(images)
        except Exception as e:
            return [(None, str(e) or type(e).__name__)] * len(images)
        finally:
            RESIDENT.touch(key)

    def over(self, batches: Iterator[list]) -> Iterator[list[tuple[list | None, str | None]]]:
        """Answers in order; a list of inputs gives no list of its own, as a batch goes on over the next inputs."""
        answers: list = []  # of inputs that have not left yet; those that wait for a full batch hold None
        waiting: list[tuple[int, object]] = []

        def flush() -> None:
            for (at, _), answer in zip(waiting, self.ask([x for _, x in waiting])):
                answers[at] = answer
            waiting.clear()

        for batch in batches:
            for x in batch:
                answers.append((None, "there is no input") if x is None else None)
                if x is not None:
                    waiting.append((len(answers) - 1, x))
                    if len(waiting) == self.batch_size:
                        flush()
            done = waiting[0][0] if waiting else len(answers)
            yield answers[:done]
            answers = answers[done:]
            waiting = [(at - done, x) for at, x in waiting]
        if waiting:
            flush()
            yield answers

    def __call__(self, column):
        over = self.over

        def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:  # pragma: no cover - runs in workers
            for answers in over(list(b) for b in batches):
                found = [None if a is None else [{"label": n, "score": s} for n, s in a] for a, _ in answers]
                yield pd.DataFrame({"classification": pd.Series(found, dtype=object), "error": pd.Series([e for _, e in answers], dtype=object)})

        classify.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(classify, RESULT)(column)
