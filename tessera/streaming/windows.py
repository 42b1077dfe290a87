"""Streaming forms: tumbling and session windows with late data, duplicates, incremental tables, anchored caps."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import ordered_fold


def tumbling(events: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n")).select("window.start", "window.end", *by, "n")


def session(events: DataFrame, at: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", *by, "n")


def distinct_events(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of the events with the same keys, within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def upsert_sink(path: str):
    """A foreachBatch function: each batch goes into its own folder, so that a repeated batch replaces itself.

    latest() reads the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: of the latest batch, in it the largest order."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct("batch", order)).alias("r"))
    return best.select("r.*").drop("batch")


def anchored_cap(seconds: list[float], width: float = 60.0, most: int = 100, start: float | None = None, n: int = 0) -> tuple[list[bool], float | None, int]:
    """Which events pass: a window opens at an event and takes most events until width seconds have passed."""
    out = []
    for t in seconds:
        if start is None or t - start >= width:
            start, n = t, 0
        n += 1
        out.append(n <= most)
    return out, start, n


def capped(events: DataFrame, key: str, at: str, width: float = 60.0, most: int = 100) -> DataFrame:
    """Batch form: events with column passed; windows are anchored at a key's first event, not at the epoch.

    A key's events are streamed in their order; a task holds its open window, not the key's events.  Events without a
    time do not pass and open no window.
    """

    def step(state: tuple[datetime, int] | None, row: dict[str, Any]) -> tuple[tuple[datetime, int] | None, tuple[bool]]:
        if row[at] is None:
            return state, (False,)
        start, n = state or (row[at], 0)
        if (row[at] - start).total_seconds() >= width:
            start, n = row[at], 0
        return (start, n + 1), (n < most,)

    return ordered_fold(events.select(key, F.col(at).cast("timestamp_ntz").alias(at)), [key], [at], step, "passed boolean").withColumn(at, F.col(at).cast("timestamp"))


#: State with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AnchoredCap(StatefulProcessor):
    """A key's open window: its start in seconds and the events in it.  A timer drops it once the watermark is past its end."""

    def __init__(self, key: str, at: str, width: float, most: int):
        self.key, self.at, self.width, self.most = key, at, width, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start double, n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(self.at, kind="stable")
        seconds = events[self.at].astype("datetime64[ns]").astype("int64") / 1e9
        start, n = self.window.get() if self.window.exists() else (None, 0)
        passed, after, n = anchored_cap(seconds.tolist(), self.width, self.most, start, n)
        if after != start:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((after + self.width) * 1000))
        self.window.update((after, n))
        yield events[[self.key, self.at]].assign(passed=passed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def capped_stream(events: DataFrame, key: str, at: str, width: float = 60.0, most: int = 100, late: str = "10 minutes") -> DataFrame:
    """Streaming form: a key's window is its state until the watermark has passed the window's end.

    A batch's events are taken in their order.  An event that comes in a later batch than its window's successors counts
    in the window that is open then; one later than the watermark is dropped.  Needs STORE as the session's
    spark.sql.streaming.stateStore.providerClass.
    """
    schema = f"{key} {dict(events.dtypes)[key]}, {at} timestamp, passed boolean"
    timed = events.select(key, F.col(at).cast("timestamp").alias(at)).withWatermark(at, late)
    return timed.groupBy(key).transformWithStateInPandas(AnchoredCap(key, at, width, most), schema, "append", "eventTime")
