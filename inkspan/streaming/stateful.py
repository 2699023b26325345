"""Streaming forms: convergence as keyed state, retention by watermark, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, mean double, m2 double, delta double, stable int, converged_at long"
OUTPUT = "owner string, element string, n long, mean double, cv double, stable int, converged boolean, converged_at long"
SMALL, RELATIVE, ABSOLUTE, NEEDED = 0.01, 0.02, 0.001, 3


def step(state: tuple, value: float, words: int) -> tuple:
    """One Welford update (A3): count, mean, squares, change of the mean, stable run, words when a run was completed."""
    n, mean, m2, _, stable, at = state
    n += 1
    new = mean + (value - mean) / n
    m2 += (value - mean) * (value - new)
    if n == 1:
        return n, new, m2, 0.0, 0, at
    delta, limit = (abs(new - mean), ABSOLUTE) if abs(mean) < SMALL else (abs(new - mean) / abs(mean), RELATIVE)
    stable = stable + 1 if delta < limit else 0
    return n, new, m2, delta, stable, words if stable == NEEDED else at


def converge(updates: DataFrame) -> DataFrame:
    """A stream of (owner, element, seq, value, words) to the state of each element; rows of a batch are taken in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, 0.0, 0.0, 0.0, 0, -1)
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            now = step(now, r.value, r.words)
        state.update(now)
        n, mean, m2, _, stable, at = now
        cv = 0.0 if n < 2 or mean < SMALL else (m2 / (n - 1)) ** 0.5 / mean
        yield pd.DataFrame([(*key, n, mean, cv, stable, stable >= NEEDED, at)], columns=["owner", "element", "n", "mean", "cv", "stable", "converged", "converged_at"])

    return updates.groupBy("owner", "element").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by type and window; what is later than the watermark is left out. Batch or stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def recent(events: DataFrame, hours: int = 24) -> DataFrame:
    """Retention of a stream: repeats of an event within the limit are dropped, and state older than it goes."""
    return events.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["event_id"])
