"""Streaming forms: the sliding-log limiter, counts in event-time windows, and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.operators.limits import SlidingLog
from scriptorium.operators.store import devices_log, first_last


def limited_stream(events: DataFrame, limit: int = 120, seconds: int = 60) -> DataFrame:
    """(event_id, user_id, ts, accepted) of a stream (event_id, user_id, ts): at most `limit` times of a user are state.

    Requests of a batch are taken by time; one that arrives in a later batch
    than its successors is judged against what was accepted by then."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = SlidingLog(limit, seconds * 1_000_000, state.get[0] if state.exists else ())
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"], kind="stable")
        rows["accepted"] = [log.offer(int(t.value // 1000)) for t in rows["ts"]]
        state.update((list(log.times),))
        yield rows[["event_id", "user_id", "ts", "accepted"]]

    return events.groupBy("user_id").applyInPandasWithState(
        step, "event_id long, user_id long, ts timestamp, accepted boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n). Our own addition: event-time windows that close `late` after their end."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def upsert_sink(path: str, **how: int):
    """A foreachBatch function that keeps devices at path by their events (user_id, ts): each batch writes its own delta."""

    def merge(batch: DataFrame, version: int) -> None:
        seen = first_last(batch).withColumn("device_id", F.col("device_id").cast("string"))
        none = F.lit(None).cast("string")
        devices_log(batch.sparkSession, path, **how).add(seen.withColumns({"user_id": none, "recovery_hash": none}), version)

    return merge
