"""Spans of one kind matched with spans of another, in one sweep over each text.

Joining spans by text with a condition on places compares all of a text's spans with all of
its edits. Here both go past once, in order of place. An edit that begins is kept while it
is open, in a heap by its number, and in a stack of those that no later one has undercut;
a span asks the heap for the least number open where it begins, and the stack, where it
ends, for the least that has begun since. So the time is that of sorting, and memory is
what is open at a place; rows stream by, sorted by Spark, which spills them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What happens at a place, in this order: spans end, empty spans, edits begin, spans begin.
ENDS, EMPTY, EDIT, BEGINS = range(4)


class Sweep:
    """One text's edits and spans in order of place."""

    def __init__(self):
        self.open: list[tuple[int, int]] = []  # (number, end), least number first
        self.starts: list[int] = []  # of edits that no later one has undercut, in order, with
        self.numbers: list[int] = []  # their numbers, which rise
        self.least: int | None = None
        self.begun: dict[int, tuple[int, int | None]] = {}
        self.without: list[dict] = []

    def _covering(self, place: int) -> int | None:
        while self.open and self.open[0][1] <= place:
            heappop(self.open)
        return self.open[0][0] if self.open else None

    def edit(self, start: int, end: int, number: int) -> None:
        self.least = number if self.least is None else min(self.least, number)
        heappush(self.open, (number, end))
        while self.numbers and self.numbers[-1] >= number:
            self.numbers.pop()
            self.starts.pop()
        self.numbers.append(number)
        self.starts.append(start)

    def begins(self, row: int, place: int) -> None:
        self.begun[row] = (place, self._covering(place))

    def ends(self, row: int) -> int | None:
        """The least number of an edit that overlaps the span."""
        place, before = self.begun.pop(row)
        k = bisect_right(self.starts, place)
        since = self.numbers[k] if k < len(self.numbers) else None
        return min((n for n in (before, since) if n is not None), default=None)

    def empty(self, place: int) -> int | None:
        return self._covering(place)


def hits(spans: DataFrame, edits: DataFrame, keys: tuple[str, ...] = ("id", "error_class")) -> DataFrame:
    """spans (keys, start, end, ...) with hit_seq: the least seq of edits (keys, start, end, seq) of the same keys that overlap.

    Spans are half open; an empty one is overlapped by what it lies strictly within. A span without places is hit by
    any edit of its keys. Keys that hold a null meet nothing. Other columns of spans stay."""
    null = F.lit(None).cast("long")
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    long = lambda c: F.col(c).cast("long")
    event = lambda place, kind, end, number, own: F.struct(place.alias("place"), F.lit(kind).alias("kind"), end.alias("end"), number.alias("number"), own.alias("own"))
    placed = F.col("start").isNotNull() & F.col("end").isNotNull()
    numbered = spans.filter(some).withColumns({"__sc_row": F.monotonically_increasing_id(), "__sc_own": F.struct(*spans.columns)})
    row, own = F.col("__sc_row"), F.col("__sc_own")
    kind_of_own = spans.select(F.struct(*spans.columns).alias("own")).schema["own"].dataType
    nothing = F.lit(None).cast(kind_of_own)
    # A span's columns travel with what tells its result: its end, or the only event it has.
    own_events = F.when(~placed, F.array(event(null, BEGINS, null, row, own))).when(
        F.col("start") == F.col("end"), F.array(event(long("start"), EMPTY, null, row, own))
    ).otherwise(F.array(event(long("start"), BEGINS, null, row, nothing), event(long("end"), ENDS, null, row, own)))
    # Keys as text tell groups apart in tasks, whatever they are.
    key = F.to_json(F.struct(*keys)).alias("key")
    asked = numbered.select(key, F.explode(own_events).alias("e"))
    given = edits.filter(some & placed).select(key, event(long("start"), EDIT, long("end"), long("seq"), nothing).alias("e"))
    events = asked.unionByName(given).select("key", "e.*").repartition("key").sortWithinPartitions("key", F.asc_nulls_first("place"), "kind", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: str | None = None
        sweep = Sweep()
        out_type: pa.DataType | None = None

        def rows(found: list[tuple[dict, int | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o for o, _ in found], out_type), pa.array([n for _, n in found], pa.int64())], names=["own", "hit_seq"])

        for b in batches:
            out_type = b.column(5).type
            found: list[tuple[dict, int | None]] = []
            for k, place, kind, end, number, own in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if k != last:
                    found += [(o, sweep.least) for o in sweep.without]
                    last, sweep = k, Sweep()
                if place is None:
                    sweep.without.append(own)
                elif kind == EDIT:
                    sweep.edit(place, end, number)
                elif kind == BEGINS:
                    sweep.begins(number, place)
                else:
                    found.append((own, sweep.ends(number) if kind == ENDS else sweep.empty(place)))
            yield rows(found)
        if out_type is not None:
            yield rows([(o, sweep.least) for o in sweep.without])

    schema = T.StructType([T.StructField("own", kind_of_own), T.StructField("hit_seq", T.LongType())])
    return events.mapInArrow(run, schema).select("own.*", "hit_seq").unionByName(spans.filter(~some).withColumn("hit_seq", null))
