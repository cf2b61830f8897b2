"""The event log as a streaming source: segments of Parquet files, read by offsets.

A segment is a folder that is written once, `segment-<number>`, and counts when it is whole.
An offset names a file and the rows of it that were read, so a query that starts again from
its checkpoint goes on where it was, whatever was appended meanwhile. A batch takes at most
`max_rows`; its partitions are slices of files, which tasks read for themselves. A consumer
with a name leaves what it has done in the log's folder when a batch is committed: admission
goes on from there after a restart, and `trimmed` removes segments that all have read.

The folder must be one that Arrow's file systems open, as the files are read in Python:
local or shared paths, HDFS, object stores.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from scriptorium.sources.files import exists, listed

_SEGMENT = re.compile(r"segment-(\d{12})")
CONSUMERS = "_consumers"
MAX_ROWS, SLICE = 1_000_000, 200_000


def append(events: DataFrame, path: str) -> int:
    """Adds a segment; its number. One writer at a time."""
    spark = events.sparkSession
    n = max((int(m[1]) for x in listed(spark, path) if (m := _SEGMENT.fullmatch(x))), default=-1) + 1
    events.write.mode("overwrite").parquet(f"{path}/_making-{uuid.uuid4().hex}/segment-{n:012}")
    made = next(x for x in listed(spark, path) if x.startswith("_making-") and exists(spark, f"{path}/{x}/segment-{n:012}/_SUCCESS"))
    _rename(spark, f"{path}/{made}/segment-{n:012}", f"{path}/segment-{n:012}")
    _delete(spark, f"{path}/{made}")
    return n


def _rename(spark: SparkSession, old: str, new: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path
    if not at(old).getFileSystem(spark._jsc.hadoopConfiguration()).rename(at(old), at(new)):
        raise OSError(f"{new} is there already")


def _delete(spark: SparkSession, path: str) -> None:
    from scriptorium.session import remove

    remove(spark, path)


def trimmed(spark: SparkSession, path: str) -> list[str]:
    """Removes the segments that every consumer has read to the end; their names. Without consumers, none."""
    log = Log(path)
    done = [log.committed(c) for c in log.consumers()]
    if not done or None in done:
        return []
    least = min(((o["file"], o["row"]) for o in done), default=("", 0))
    gone = [s for s in log.segments() if s < least[0].split("/")[0]]
    for s in gone:
        _delete(spark, f"{path}/{s}")
    return gone


def schema_of(file: pq.ParquetFile) -> pa.Schema:
    """A file's columns; Spark's timestamps of 96 bits are instants, which Arrow doesn't know."""
    instants = {file.schema.column(i).path for i in range(len(file.schema)) if file.schema.column(i).physical_type == "INT96"}
    return pa.schema([pa.field(f.name, pa.timestamp("us", "UTC")) if f.name in instants else f for f in file.schema_arrow])


class Log:
    """The folder as tasks and the query's reader see it."""

    def __init__(self, path: str):
        self.system, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self._rows: dict[str, int] = {}

    def _names(self, folder: str) -> list[str]:
        found = self.system.get_file_info(pafs.FileSelector(f"{self.root}/{folder}".rstrip("/"), allow_not_found=True))
        return sorted(x.base_name for x in found)

    def segments(self) -> list[str]:
        return [x for x in self._names("") if _SEGMENT.fullmatch(x)]

    def files(self, since: str = "") -> list[str]:
        """Files from that of an offset on, by segment and name."""
        first = since.split("/")[0]
        return [f for s in self.segments() if s >= first for n in self._names(s) if n.endswith(".parquet") and (f := f"{s}/{n}") >= since]

    def open(self, file: str) -> pq.ParquetFile:
        return pq.ParquetFile(self.system.open_input_file(f"{self.root}/{file}"), coerce_int96_timestamp_unit="us")

    def rows(self, file: str) -> int:
        if file not in self._rows:
            with self.open(file) as f:
                self._rows[file] = f.metadata.num_rows
        return self._rows[file]

    def consumers(self) -> list[str]:
        return [x.removesuffix(".json") for x in self._names(CONSUMERS) if x.endswith(".json")]

    def committed(self, consumer: str) -> dict | None:
        try:
            with self.system.open_input_stream(f"{self.root}/{CONSUMERS}/{consumer}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def commit(self, consumer: str, offset: dict) -> None:
        """Written beside and moved, so that it is there whole or not."""
        self.system.create_dir(f"{self.root}/{CONSUMERS}", recursive=True)
        beside = f"{self.root}/{CONSUMERS}/.{consumer}-{uuid.uuid4().hex}"
        with self.system.open_output_stream(beside) as f:
            f.write(json.dumps(offset).encode())
        self.system.move(beside, f"{self.root}/{CONSUMERS}/{consumer}.json")

    def after(self, offset: dict, most: int) -> dict:
        """The offset at most so many rows on."""
        at = dict(offset)
        for f in self.files(offset["file"]):
            skip = at["row"] if f == at["file"] else 0
            take = min(most, self.rows(f) - skip)
            if take <= 0 and most > 0:
                continue
            at = {"file": f, "row": skip + take}
            most -= take
            if most <= 0:
                break
        return at

    def slices(self, start: dict, end: dict, size: int) -> list[Slice]:
        out = []
        for f in self.files(start["file"]):
            if f > end["file"]:
                break
            a = start["row"] if f == start["file"] else 0
            z = end["row"] if f == end["file"] else self.rows(f)
            out += [Slice(f, i, min(i + size, z)) for i in range(a, z, size)]
        if start["file"] and not self.system.get_file_info(f"{self.root}/{start['file']}").type == pafs.FileType.File and start["row"]:
            raise FileNotFoundError(f"{start['file']}, which was read up to row {start['row']}, isn't in the log any more")
        return out


@dataclass
class Slice(InputPartition):
    file: str
    first: int
    last: int


class EventLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.consumer = options["path"], options.get("consumer")
        self.most, self.slice = int(options.get("max_rows", MAX_ROWS)), int(options.get("slice", SLICE))
        self.log = Log(self.path)
        self.at: dict | None = self.consumer and self.log.committed(self.consumer) or None

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def latestOffset(self) -> dict:
        """Where the next batch may end. What was admitted before is known from the last batch, or what was committed."""
        return self.log.after(self.at or self.initialOffset(), self.most)

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        if self.at is None or (end["file"], end["row"]) > (self.at["file"], self.at["row"]):
            self.at = end
        return self.log.slices(start, end, self.slice)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        at = 0
        with Log(self.path).open(partition.file) as f:
            for g in range(f.metadata.num_row_groups):
                n = f.metadata.row_group(g).num_rows
                if at < partition.last and at + n > partition.first:
                    rows = f.read_row_group(g).slice(max(0, partition.first - at), min(n, partition.last - at) - max(0, partition.first - at))
                    yield from rows.cast(schema_of(f)).to_batches()
                at += n

    def commit(self, end: dict) -> None:
        self.at = end
        if self.consumer:
            self.log.commit(self.consumer, end)


class EventLogSource(DataSource):
    """spark.readStream.format("event_log").option("path", ...).option("consumer", ...).option("max_rows", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        log = Log(self.options["path"])
        for f in log.files():
            with log.open(f) as p:
                return from_arrow_schema(schema_of(p))
        raise FileNotFoundError(f"no segment in {self.options['path']}: give the stream a schema")

    def streamReader(self, schema: T.StructType) -> EventLogReader:
        return EventLogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLogSource)
