"""A keyed table as a log of sorted deltas: each batch adds its own, reading merges them.

A delta is a run of Parquet files in folders of key ranges (by hash), a row for each key of
its batch. Columns merge by rules that don't depend on order: least, greatest, or the value
that came with the greatest of another column. So runs may be merged in any grouping:
whenever a level has `fanout` runs they become one of the next, and what is written follows
the batches, each row once a level, not the table. A run's folder names the batches that it
holds; a run counts once it is written whole, and then those whose batches it holds no
longer do, whether they have been removed yet or not. A batch that comes again, as a stream
repeats its last one after a failure, is there already and changes nothing. One writer at a
time; readers need none of its memory, only the folder.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import remove
from scriptorium.sources.files import exists, listed

RANGE = "__sc_range"
_NAME = re.compile(r"run-(\d+)-(\d+)-(\d+)")


@dataclass(frozen=True)
class Run:
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"run-{self.level}-{self.first:012}-{self.last:012}"

    def holds(self, other: Run) -> bool:
        return self.first <= other.first and other.last <= self.last and self != other


def _at(column: str) -> str:
    return f"__sc_at_{column}"


@dataclass(frozen=True)
class UpsertLog:
    """rules: for each column `min`, `max`, or `last by <column>`. All other columns of a batch are left out."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    rules: tuple[tuple[str, str], ...]
    ranges: int = 16
    fanout: int = 4

    def _rules(self) -> list[Column]:
        out = []
        for column, rule in self.rules:
            if rule in ("min", "max"):
                out.append(getattr(F, rule)(column).alias(column))
            else:  # with the time that it came with; of equal times the greater value, so that no order of runs matters
                newest = F.max(F.when(F.col(_at(column)).isNotNull(), F.struct(_at(column), column)))
                out += [newest[column].alias(column), newest[_at(column)].alias(_at(column))]
        return out

    def _merged(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(self.key, *keys).agg(*self._rules())

    def runs(self) -> list[Run]:
        """The runs that count, by their batches; one listing of the folder."""
        there = [Run(*map(int, m.groups())) for n in listed(self.spark, self.path) if (m := _NAME.fullmatch(n))]
        whole = [r for r in there if exists(self.spark, f"{self.path}/{r.name}/_SUCCESS")]
        return sorted((r for r in whole if not any(x.holds(r) for x in whole)), key=lambda r: r.first)

    def _rows(self, runs: list[Run]) -> DataFrame:
        kinds = dict(f.strip().rsplit(" ", 1) for f in self.schema.split(","))
        times = [f"{_at(c)} {kinds[r.removeprefix('last by ')]}" for c, r in self.rules if r not in ("min", "max")]
        schema = ", ".join([self.schema, *times, f"{RANGE} int"])
        if not runs:
            return self.spark.createDataFrame([], schema)
        read = lambda r: self.spark.read.schema(schema).parquet(f"{self.path}/{r.name}")
        out = read(runs[0])
        for r in runs[1:]:
            out = out.unionByName(read(r))
        return out

    def read(self) -> DataFrame:
        """The table: a row for each key."""
        return self._merged(self._rows(self.runs())).select(*self._columns())

    def _columns(self) -> list[str]:
        return [self.key, *(c for c, _ in self.rules)]

    def find(self, keys: list) -> DataFrame:
        """The rows of some keys; only their ranges are read."""
        asked = self.spark.createDataFrame([(k,) for k in keys], self._key_ddl()).withColumn(RANGE, self._range())
        ranges = sorted({r[RANGE] for r in asked.select(RANGE).collect()})
        rows = self._rows(self.runs()).filter(F.col(RANGE).isin(ranges) & F.col(self.key).isin(keys))
        return self._merged(rows).select(*self._columns())

    def _key_ddl(self) -> str:
        return next(f.strip() for f in self.schema.split(",") if f.strip().startswith(f"{self.key} "))

    def _range(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.ranges)).cast("int")

    def _write(self, rows: DataFrame, run: Run) -> None:
        rows.write.mode("overwrite").partitionBy(RANGE).parquet(f"{self.path}/{run.name}")

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Adds a batch, unless it is there; whether it was added. Rows without key are left out."""
        if any(r.first <= batch <= r.last for r in self.runs()):
            return False
        times = {_at(c): F.when(F.col(c).isNotNull(), F.col(r.removeprefix("last by "))) for c, r in self.rules if r not in ("min", "max")}
        keyed = rows.filter(F.col(self.key).isNotNull()).withColumns({RANGE: self._range(), **times})
        self._write(self._merged(keyed, RANGE), Run(0, batch, batch))
        self._compact()
        return True

    def _compact(self) -> None:
        counted = {r.name for r in self.runs()}
        # What an earlier merge replaced; what this one does stays until the next, for readers that have begun.
        stale = [n for n in listed(self.spark, self.path) if _NAME.fullmatch(n) and n not in counted and exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        level = 0
        while True:
            runs = self.runs()
            if level > max((r.level for r in runs), default=-1):
                break
            # Only neighbours are merged: a run's batches are those between its first and last.
            same = [r for r in runs if r.level == level]
            if len(same) >= self.fanout and [r for r in runs if same[0].first <= r.first and r.last <= same[-1].last] == same:
                self._write(self._merged(self._rows(same), RANGE), Run(level + 1, same[0].first, same[-1].last))
            level += 1
        for n in stale:
            remove(self.spark, f"{self.path}/{n}")
