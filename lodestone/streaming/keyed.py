"""Keyed state in event time: rows wait in list state until the watermark has passed them, and then take effect in order of time.

A key holds the rows that may still be overtaken by earlier ones (a watermark's lateness of them), one window, and one timer
at a time. So the order of arrival, the cut into batches and a restart between two of them change nothing. A key whose window
is over and that holds no rows has no state. Rows of a batch are read one by one; a batch's size is the source's to bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which timers and list state need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class InOrder(StatefulProcessor):
    """Holds rows (at: milliseconds, event, mark) until they are due; a window begins at the first row at or after the end of the one before."""

    def __init__(self, width: int) -> None:
        self.width = width  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, event long, mark boolean")
        self.window = handle.getValueState("window", "start long, n long, mark boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        new, first = [], None
        for r in rows:
            new.append((r.at_ms, r.event_id, r.mark))
            first = r.at_ms if first is None else min(first, r.at_ms)
            if len(new) == 1000:
                self.held.appendList(new)
                new = []
        if new:
            self.held.appendList(new)
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for r in self.held.get() if self.held.exists() else ():
            (due if r[0] <= upto else later).append(tuple(r))
        start, n, mark = self.window.get() if self.window.exists() else (0, 0, False)
        for at, event, flag in sorted(due):
            if n and at >= start + self.width:
                yield from self.closed(key, start, n, mark)
                n = 0
            if not n:
                start, mark = at, False
            n, mark = n + 1, mark or flag
            yield from self.passed(key, event, at, start, n)
        if due:
            self.held.put(later) if later else self.held.clear()
        if n and upto >= start + self.width:
            yield from self.closed(key, start, n, mark)
            n = 0
        if n:
            self.window.update((start, n, mark))
        elif self.window.exists():
            self.window.clear()
        following = [min(later)[0]] if later else []
        if n:
            following.append(start + self.width)
        if following:
            self.handle.registerTimer(min(following))

    def passed(self, key: tuple, event: int, at: int, start: int, n: int) -> Iterator[Row]:
        """What a row gives, as the n-th of the window that began at start."""
        return iter(())

    def closed(self, key: tuple, start: int, n: int, mark: bool) -> Iterator[Row]:
        """What a window gives that is over."""
        return iter(())

    def close(self) -> None:
        pass


class RateWindow(InOrder):
    """Lets `limit` rows of each window pass and tells the others how long to wait."""

    def __init__(self, width: int, limit: int) -> None:
        super().__init__(width)
        self.limit = limit

    def passed(self, key: tuple, event: int, at: int, start: int, n: int) -> Iterator[Row]:
        yield Row(user_id=key[0], event_id=event, allowed=n <= self.limit, wait_ms=0 if n <= self.limit else start + self.width - at)


class Coalesced(InOrder):
    """One job for all requests of a window: a full one among them makes the whole job full."""

    def closed(self, key: tuple, start: int, n: int, mark: bool) -> Iterator[Row]:
        yield Row(user_id=key[0], started_ms=start, requests=n, full=mark)


def _in_order(stream: DataFrame, processor: InOrder, schema: str, late: str, full: str) -> DataFrame:
    rows = stream.withWatermark("at", late).select("user_id", "event_id", "at", F.unix_millis("at").alias("at_ms"), F.coalesce(F.expr(full), F.lit(False)).alias("mark"))
    return rows.groupBy("user_id").transformWithState(processor, schema, "Append", "EventTime")


def rate_limited(stream: DataFrame, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """user_id, event_id, allowed, wait_ms: a key's window begins at its first hit and lasts `seconds`; `limit` hits of it pass."""
    return _in_order(stream, RateWindow(seconds * 1000, limit), "user_id long, event_id long, allowed boolean, wait_ms long", late, "false")


def coalesced(stream: DataFrame, seconds: int, full: str, late: str = "1 hour") -> DataFrame:
    """user_id, started_ms, requests, full: requests within `seconds` of a key's first one become one job, which is full if
    any of them is (an SQL condition)."""
    return _in_order(stream, Coalesced(seconds * 1000), "user_id long, started_ms long, requests long, full boolean", late, full)
