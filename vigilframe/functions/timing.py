"""Calls that may not take longer than they are given."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable


def within(seconds: float | None, call: Callable, *args):
    """call(*args), or TimeoutError after `seconds`. What runs on is a daemon thread and does not hold its process."""
    if not seconds:
        return call(*args)
    answers: queue.Queue = queue.Queue(1)

    def run() -> None:
        try:
            answers.put((call(*args), None))
        except BaseException as e:
            answers.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, problem = answers.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError from None
    if problem is not None:
        raise problem
    return value
