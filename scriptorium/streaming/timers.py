"""Streams with state that ends: limits, debouncing and a session's ignore list, by event-time timers.

Each keeps per user what a later event may still need, and sets a timer for when nothing
can: once the watermark has passed it, the state is cleared, so an idle user costs nothing.
Events up to the watermark's delay late are judged; later ones are dropped by the
watermark, as all of Spark's stateful operators do. These operators need the state store
that keeps state on disk: call `on_disk` before a query starts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000


def on_disk(spark: SparkSession) -> None:
    """Queries that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def micros(ts: pd.Series) -> list[int]:
    return [int(t.value // 1000) for t in ts]


def timestamps(at: list[int]) -> pd.Series:
    return pd.to_datetime(pd.Series(at, dtype="int64"), unit="us")


def millis_after(at: int) -> int:
    """The first whole millisecond that isn't before a time in microseconds."""
    return -(-at // 1000)


class _Limits(StatefulProcessor):
    """Accepted times of a user, in order; those that no event within the watermark's delay can meet go."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.window = limit, seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getValueState("times", "at array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        held = list(self.times.get()[0]) if self.times.exists() else []
        good = []
        for at in micros(some["ts"]):
            # One that comes late is judged by what was accepted by now in any window with it, later times included.
            fine = bisect_right(held, at + self.window) - bisect_left(held, at - self.window) < self.limit
            if fine:
                insort(held, at)
            good.append(fine)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = held[bisect_left(held, passed - self.window) :]
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if held:
            self.times.update((held,))
            self.handle.registerTimer(millis_after(held[-1] + self.window))
        else:
            self.times.clear()
        some["accepted"] = good
        yield some[["event_id", "user_id", "ts", "accepted"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(events: DataFrame, limit: int = 120, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, ts, accepted) of a stream (event_id, user_id, ts): at most `limit` accepted requests of a user within `seconds`."""
    return events.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(
        _Limits(limit, seconds), "event_id long, user_id long, ts timestamp, accepted boolean", "append", "eventTime"
    )


class _Debounce(StatefulProcessor):
    """The events of a user that another may still follow closely."""

    def __init__(self, millis: int):
        self.gap = millis * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "at long, event_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows))
        new = sorted(zip(micros(some["ts"]), map(int, some["event_id"]), strict=True))
        held = sorted([*((int(a), int(i)) for a, i in self.held.get()), *new])
        self.held.put(held)
        for at, _ in new:
            self.handle.registerTimer(millis_after(at + self.gap))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = sorted((int(a), int(i)) for a, i in self.held.get())
        out = [x for x, after in zip(held, [*held[1:], None], strict=False) if x[0] + self.gap <= passed and (after is None or after[0] - x[0] >= self.gap)]
        rest = [x for x in held if x[0] + self.gap > passed]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame({"event_id": [i for _, i in out], "user_id": key[0], "ts": timestamps([a for a, _ in out])})

    def close(self) -> None:
        pass


def debounced(events: DataFrame, millis: int = 600, late: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, ts): the events that no other of the user follows within millis, as operators.limits.debounced
    finds them in a table; each comes once the watermark says that none can any more."""
    return events.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(_Debounce(millis), "event_id long, user_id long, ts timestamp", "append", "eventTime")


class _Ignored(StatefulProcessor):
    """What the user of a session has ignored; it goes when the session has been idle for long enough."""

    def __init__(self, idle_seconds: int):
        self.idle = idle_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ignored = handle.getMapState("ignored", "error_class string, original string, first string", "since long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # At one time, what is ignored comes before what is shown.
        some = pd.concat(list(rows))
        some = some.assign(shown=some["kind"] != "ignore").sort_values(["ts", "shown"], kind="stable")
        keep = []
        last = self.last.get()[0] if self.last.exists() else None
        for at, kind, *what in zip(micros(some["ts"]), some["kind"], *(some[c].fillna("") for c in ("error_class", "original", "first")), strict=True):
            if last is not None and at - last > self.idle:
                self.ignored.clear()  # a new session of the same user
            last = at if last is None else max(last, at)
            if kind == "ignore":
                self.ignored.updateValue(tuple(what), (at,))
            keep.append(kind != "ignore" and not self.ignored.containsKey(tuple(what)))
        self.last.update((last,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(millis_after(last + self.idle))
        yield some[keep][["session", "ts", "error_class", "original", "first"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.ignored.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def without_ignored(actions: DataFrame, idle_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """The edits (session, ts, error_class, original, first) of a stream of these with `kind` that weren't ignored before in their session.

    kind is `ignore` for what the user dismisses; anything else is an edit that is shown."""
    out = "session string, ts timestamp, error_class string, original string, first string"
    return actions.withWatermark("ts", late).groupBy("session").transformWithStateInPandas(_Ignored(idle_seconds), out, "append", "eventTime")
