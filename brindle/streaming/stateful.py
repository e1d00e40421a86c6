"""Monitors that keep state by key and act on timers: event time for order, processing time for silence.

Both take rows (key, us: event time in microseconds, ...) and run with ``transformWithStateInPandas``, so their state lies in
RocksDB beside the checkpoint and moves with its partition when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
WAITS = np.dtype([("us", np.int64), ("id", np.int64), ("value", np.float64)])


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which timers and several state variables need."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


class OrderedTest(StatefulProcessor):
    """Sequential test in event time: rows wait until the watermark has passed them and are then taken in order.

    Yields what is final (n, log_e) and what it comes to with the rows that wait (n_seen, log_e_seen). What waits of a key
    is bounded by the rows of the watermark's delay, and lies in the state packed by spans of time, a span in chunks; Python
    holds the rows of one span at once, 24 bytes each. The test itself is four numbers.
    """

    SPAN = 3_600_000_000  # microseconds
    HELD = 500_000  # rows of a key and batch before they are packed

    def __init__(self, null_mean: float):
        self.null_mean = null_mean

    def init(self, handle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "n long, s1 double, s2 double, log_e double")
        self.spans = handle.getMapState("spans", "span long", "chunks int, first long")
        self.waiting = handle.getMapState("waiting", "span long, chunk int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, n = [], 0
        for frame in rows:
            frame = frame.dropna(subset=["us", "value"])
            held.append(self._packed(frame))
            n += len(frame)
            if n >= self.HELD:
                self._put(np.concatenate(held))
                held, n = [], 0
        if n:
            self._put(np.concatenate(held))
        yield self._released(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._released(key, timerValues)

    def _packed(self, frame: pd.DataFrame) -> np.ndarray:
        out = np.empty(len(frame), WAITS)
        out["us"], out["value"] = frame["us"].to_numpy(np.int64), frame["value"].to_numpy(float)
        out["id"] = frame["id"].fillna(np.iinfo(np.int64).max).to_numpy(np.int64)  # rows without one come last
        return out

    def _put(self, rows: np.ndarray) -> None:
        """Add rows to their spans, a chunk a span."""
        rows = rows[np.argsort(rows["us"], kind="stable")]
        span = rows["us"] // self.SPAN
        starts = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1]]))
        for low, high in zip(starts, [*starts[1:], len(rows)], strict=True):
            at, first = int(span[low]), int(rows["us"][low])
            chunks, least = self.spans.getValue((at,)) if self.spans.containsKey((at,)) else (0, first)
            self.waiting.updateValue((at, chunks), (rows[low:high].tobytes(),))
            self.spans.updateValue((at,), (chunks + 1, min(least, first)))

    def _span(self, at: int, chunks: int) -> np.ndarray:
        """Rows of a span in order."""
        rows = np.concatenate([np.frombuffer(self.waiting.getValue((at, i))[0], WAITS) for i in range(chunks)])
        return rows[np.lexsort((rows["value"], rows["id"], rows["us"]))]

    def _released(self, key, timers) -> pd.DataFrame:
        mark = timers.getCurrentWatermarkInMs() * 1000
        state = tuple(self.done.get()) if self.done.exists() else (0, 0.0, 0.0, 0.0)
        seen, first = state, None
        for at, chunks in sorted((k[0], v[0]) for k, v in self.spans.iterator()):
            rows = self._span(at, chunks)
            ready = int(np.searchsorted(rows["us"], mark, side="right"))
            if ready:
                state = seen = self._taken(state, rows[:ready])
                for i in range(chunks):
                    self.waiting.removeKey((at, i))
                self.spans.removeKey((at,))
                rows = rows[ready:]
                if len(rows):
                    self._put(rows)
            if len(rows):
                first = int(rows["us"][0]) if first is None else first
                seen = self._taken(seen, rows)
        if state[0]:
            self.done.update(state)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return pd.DataFrame({"key": [key[0]], "n": [state[0]], "log_e": [state[3]], "n_seen": [seen[0]], "log_e_seen": [seen[3]]})

    def _taken(self, state: tuple, rows: np.ndarray) -> tuple:
        """The test after some more rows, added up one by one in their order."""
        n, s1, s2, log_e = state
        d = rows["value"] - self.null_mean
        s1, s2 = np.cumsum(np.concatenate([[s1], d])), np.cumsum(np.concatenate([[s2], d * d]))
        some = s2[:-1] > 0
        stake = np.where(some, np.clip(s1[:-1] / np.where(some, s2[:-1], 1.0), -0.5, 0.5), 0.0)
        gain = np.log(np.maximum(1e-10, 1 + stake * d))
        return n + len(rows), float(s1[-1]), float(s2[-1]), float(np.cumsum(np.concatenate([[log_e], gain]))[-1])

    def close(self) -> None:
        pass


def ordered_test(events: DataFrame, key: str, at: str, tie: str, value: str, null_mean: float, delay: str) -> DataFrame:
    """(key, n, log_e, n_seen, log_e_seen) a key and batch, in update mode; log_e is capped at 500 as in the batch form.

    ``tie`` orders rows of one time; rows later than the delay are dropped by Spark, null values are left out.
    """
    rows = events.withWatermark(at, delay).select(F.col(at), F.col(key).alias("key"), F.unix_micros(at).alias("us"), F.col(tie).cast("long").alias("id"), F.col(value).cast("double").alias("value"))
    kind = events.schema[key].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(OrderedTest(null_mean), f"key {kind}, n long, log_e double, n_seen long, log_e_seen double", "Update", "EventTime")
    return out.select(F.col("key").alias(key), "n", F.least(F.lit(500.0), "log_e").alias("log_e"), "n_seen", F.least(F.lit(500.0), "log_e_seen").alias("log_e_seen"))


class FreshnessWatch(StatefulProcessor):
    """Cadence of a key from the middle gap between its days, and how far its last day lies behind the clock.

    A processing-time timer asks again every ``every`` milliseconds, so a key turns stale without any new event.
    State is one entry for each day that has events.
    """

    def __init__(self, every: int, period: int, clock: int | None):
        self.every, self.period, self.clock = every, period, clock

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for day, n in (frame["us"].dropna() // (self.period * 1_000_000)).astype(int).value_counts().items():
                held = self.days.getValue((int(day),))[0] if self.days.containsKey((int(day),)) else 0
                self.days.updateValue((int(day),), (held + int(n),))
        yield self._judged(key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._judged(key, timerValues.getCurrentProcessingTimeInMs())

    def _judged(self, key, now: int) -> pd.DataFrame:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now + self.every)
        days = sorted(d[0] for d in self.days.keys())
        gaps = sorted(b - a for a, b in zip(days, days[1:], strict=False))
        gap = gaps[len(gaps) // 2] if gaps else None
        age = (now if self.clock is None else self.clock) // (self.period * 1000) - days[-1] if days else None
        cadence = "unknown" if gap is None else "daily" if gap <= 1.5 else "weekly" if gap <= 8 else "other"
        limit = {"daily": 2, "weekly": 10}.get(cadence)
        status = "unknown" if age is None else "historical" if age > 90 else "stale" if limit and age > limit else "fresh"
        return pd.DataFrame({"key": [key[0]], "last": pd.array([days[-1] if days else None], "Int64"), "middle_gap": pd.array([gap], "Int64"), "age": pd.array([age], "Int64"), "cadence": [cadence], "status": [status], "asked_ms": [now]})

    def close(self) -> None:
        pass


def freshness_watch(events: DataFrame, key: str, at: str, every_ms: int = 60_000, period_s: int = 86_400, clock_ms: int | None = None) -> DataFrame:
    """(key, last, middle_gap, age, cadence, status, asked_ms), days being numbers of periods since 1970; update mode.

    Keys are judged at every batch that brings events of them and then every so many milliseconds. Over 90 days old:
    historical; over 2 behind a daily or 10 behind a weekly cadence: stale. A fixed clock is for replays.
    """
    rows = events.select(F.col(key).alias("key"), F.unix_micros(at).alias("us"))
    kind = events.schema[key].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(FreshnessWatch(every_ms, period_s, clock_ms), f"key {kind}, last long, middle_gap long, age long, cadence string, status string, asked_ms long", "Update", "ProcessingTime")
    return out.withColumnRenamed("key", key)
