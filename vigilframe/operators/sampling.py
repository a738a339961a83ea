"""Frame sampling: the times to look at, as array expressions over (duration, fps) columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Times nearer than this count as one; the guard where no frame rate is known.
TOLERANCE, UNKNOWN_GUARD = 0.05, 0.05
_NONE = "array<double>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def uniform(duration: Column, count: Column) -> Column:
    """The middles of `count` equal parts; none if the count or duration is not positive."""
    times = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: (i + F.lit(0.5)) / count * duration)
    return F.when((count > 0) & (duration > 0), times).otherwise(_empty())


def at_rate(duration: Column, rate: Column) -> Column:
    """0, 1/rate, ... below the duration, by repeated addition (rounding adds up as it does there)."""

    def times(seconds: pd.Series, a_second: pd.Series) -> pd.Series:  # pragma: no cover - runs in workers
        out = []
        for d, r in zip(seconds, a_second):
            if d > 0 and r > 0:  # a null is NaN here
                found = np.cumsum(np.full(int(np.ceil(d * r)) + 2, 1.0 / r))
                found = np.concatenate([[0.0], found[:-1]])
                out.append(found[: int(np.searchsorted(found, d))])
            else:
                out.append(np.zeros(0))
        return pd.Series(out, index=seconds.index, dtype=object)

    times.__annotations__ = {"seconds": pd.Series, "a_second": pd.Series, "return": pd.Series}
    return F.pandas_udf(times, _NONE)(duration.cast("double"), rate.cast("double"))


def every_nth(duration: Column, fps: Column, nth: Column) -> Column:
    """Times of frames 0, nth, 2 nth, ... below the duration."""
    last = F.greatest(F.ceil(duration * fps).cast("long") - 1, F.lit(0).cast("long"))
    times = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), last, F.greatest(nth, F.lit(1)).cast("long")), lambda f: f / fps), lambda t: t < duration)
    return F.when((nth > 0) & (fps > 0) & (duration > 0), times).otherwise(_empty())


def step_times(method: Column, duration: Column, fps: Column, count: Column, rate: Column, nth: Column, probed: Column) -> Column:
    """Times of one sampling step; `probed` has those of keyframes and scene changes. A missing parameter is an error."""

    def need(name: str, value: Column, times: Column) -> Column:
        return F.when(value.isNull(), F.raise_error(F.concat(method, F.lit(f" sampling needs {name}"))).cast(_NONE)).otherwise(times)

    return (
        F.when(method == "uniform", need("count", count, uniform(duration, count)))
        .when(method == "fps", need("fps", rate, at_rate(duration, rate)))
        .when(method == "every_nth", need("nth", nth, every_nth(duration, fps, nth)))
        .when(method.isin("iframes", "scene"), F.coalesce(probed, _empty()))
        .otherwise(F.raise_error(F.concat(F.lit("unknown sampling method: "), method)).cast(_NONE))
    )


def last_seek(duration: Column, fps: Column) -> Column:
    """The latest time worth seeking: one frame (at least 1 ms, 0.05 s if the rate is unknown) before the end."""
    guard = F.when(fps > 0, F.greatest(F.try_divide(F.lit(1.0), fps), F.lit(1e-3))).otherwise(F.lit(UNKNOWN_GUARD))
    return F.greatest(duration - guard, F.lit(0.0))


def merge_steps(steps: Column, duration: Column, fps: Column) -> Column:
    """Times of all steps in step order, each ascending and clamped; of times within the tolerance the first stays."""
    most = last_seek(duration, fps)
    clamped = F.transform(F.flatten(F.transform(steps, lambda ts: F.array_sort(ts))), lambda t: F.greatest(F.lit(0.0), F.least(t, most)))
    return dedupe(clamped)


def first_come(times, tolerance: float = TOLERANCE) -> list:
    """Greedy: a time stays unless one that stays lies within the tolerance (inclusive).

    Times that stay lie in cells twice as wide, so only three cells are looked at for each: linear in the
    times. What has no place (null, NaN, infinite) is near nothing.
    """
    cells: dict[int, list[float]] = {}
    out = []
    for t in times:
        if t is None or not math.isfinite(t):
            out.append(t)
            continue
        at = math.floor(t / (2 * tolerance))
        if not any(abs(c - t) <= tolerance for k in (at - 1, at, at + 1) for c in cells.get(k, ())):
            cells.setdefault(at, []).append(t)
            out.append(t)
    return out


def dedupe(times: Column, tolerance: float = TOLERANCE) -> Column:
    """`first_come` of an array column."""

    def kept(rows: pd.Series) -> pd.Series:  # pragma: no cover - runs in workers
        return pd.Series([None if ts is None else first_come(ts, tolerance) for ts in rows], index=rows.index, dtype=object)

    kept.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(kept, _NONE)(times)
