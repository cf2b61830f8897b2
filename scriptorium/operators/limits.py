"""Rate limits and debouncing over a log of requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds of a timestamp with or without time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def trailing_count(events: DataFrame, seconds: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """events with n: requests of the user in the trailing window, both ends included."""
    w = Window.partitionBy(user).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n", F.count("*").over(w))


class SlidingLog:
    """Accepted requests of one user; a rejected one isn't recorded."""

    def __init__(self, limit: int, micros: int, times=()):
        self.limit, self.micros, self.times = limit, micros, deque(times)

    def offer(self, at: int) -> bool:
        while self.times and self.times[0] < at - self.micros:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(at)
        return True


def limited(events: DataFrame, limit: int = 120, seconds: int = 60, user: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """(key, user, ts, accepted): the exact sliding log.

    A user's requests pass one task in order, and no more than `limit` times of
    one user are held: rows stream by, sorted within partitions, so a user with a
    third of all requests needs no more memory than another."""
    rows = events.select(F.col(key), F.col(user), micros(ts).alias("__at")).repartition(F.col(user)).sortWithinPartitions(user, "__at", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, log = object(), SlidingLog(limit, seconds * 1_000_000)
        for b in batches:
            good = []
            for who, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if who != last:
                    last, log = who, SlidingLog(limit, seconds * 1_000_000)
                good.append(at is None or log.offer(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(good, pa.bool_())], names=[*b.schema.names, "accepted"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(run, ", ".join([*kinds, "accepted boolean"])).select(key, user, F.timestamp_micros("__at").alias(ts), "accepted")


def debounced(events: DataFrame, millis: int = 600, user: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """The events that no other of the user follows within millis."""
    w = Window.partitionBy(user).orderBy(ts, key)
    later = micros(F.lead(ts).over(w)) - micros(ts)
    return events.withColumn("__gap", later).filter(F.col("__gap").isNull() | (F.col("__gap") >= millis * 1000)).drop("__gap")
