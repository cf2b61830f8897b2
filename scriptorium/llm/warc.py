"""WARC archives as a PySpark Python data source.

Writing: each task writes archives of a bounded size, every record a gzip member
of its own whose header holds the member's length (the `SL` field; members of 4 GiB
or more go without), and the commit writes the list of files that count, so that a
task that ran twice or was lost leaves nothing that is read.

Reading: the driver plans the listed files, or without a list all files named *.warc*,
into partitions by size; predicates on the record type, target, digest and record ids
are pushed down. A record's headers are inflated first. Where these don't pass, or
payloads aren't wanted, the rest of the record isn't decoded: a member that says its
length is skipped; of one that doesn't, the record's length is known from its headers,
so its end is where that length, as gzip's trailer has it, stands before the next
member's mark, or at the end of the file, and is found without inflating; only where
it isn't (several records in one member), the record is inflated in parts and
dropped. Archives that aren't compressed are skipped by seeking. Whatever is read goes
through buffers of a bounded size, but for a payload that is wanted.

Folders are reached through pyarrow's file systems, by URI.

Defined results: header names are found in any case; a revisit has no payload; a
file that ends within a record or isn't an archive raises ValueError with its name and
place; an empty file or folder has no records.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage


SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, headers map<string,string>, payload binary"
#: Columns that come from one header each.
NAMED = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
MANIFEST = "_archives.json"
DATE = "1970-01-01T00:00:00Z"


def file_system(uri: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def _safe(value: str) -> str:
    """A header value in one line: control characters become percent codes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, record_id: str, uri: str | None, digest: str | None, refers_to: str | None, extra: dict[str, str], payload: bytes | None) -> bytes:
    """A record in WARC/1.1; its block is an HTTP response, of which a revisit has the head only."""
    n = extra.get("X-Payload-Length", str(len(payload or b"")))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (payload or b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": digest, "WARC-Refers-To": refers_to}
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head |= {"Content-Type": "application/http; msgtype=response", **extra, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {_safe(v)}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """raw as a gzip member that says how long it is, if that fits its field."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    size = 12 + 12 + len(body) + 8
    size = size if size < 1 << 32 else 0
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HII", 8, size, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class Headers(dict):
    """Headers as written, found in any case; of equal names, the first counts."""

    def __init__(self, pairs):
        super().__init__()
        self.low: dict[str, str] = {}
        for k, v in pairs:
            self.setdefault(k, v)
            self.low.setdefault(k.lower(), v)

    def find(self, name: str) -> str | None:
        return self.low.get(name.lower())


def parsed(head: bytes) -> Headers:
    lines = [line.partition(b":") for line in head.split(b"\r\n")[1:]]
    text = lambda x: x.strip().decode("utf-8", "surrogateescape").encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return Headers((text(k), text(v)) for k, _, v in lines if k.strip())


def _payload(block: bytes) -> bytes:
    head, mark, body = block.partition(b"\r\n\r\n")
    return body if mark and head.startswith(b"HTTP/") else block


MARK = b"\x1f\x8b\x08"


class Source:
    """An archive's bytes, inflated if they are compressed, forwards only."""

    def __init__(self, stream, name: str = "archive", part: int = 1 << 16):
        self.stream, self.name, self.part = stream, name, part
        self.at = 0  # where the member being read begins
        self.raw, self.raw_at = b"", 0  # what was read of the file and not inflated, and where it begins
        self.text = b""  # what was inflated and not read
        self.inflate = None
        self.inflated = self.said = 0  # bytes inflated so far, and the member's length by its header, 0 if it doesn't say
        self.alone = True  # as long as no member was found to hold several records
        self.zipped = self._peek(3) == MARK

    def fail(self, why: str) -> ValueError:
        return ValueError(f"{self.name}, member at {self.at}: {why}")

    def _peek(self, n: int) -> bytes:
        while len(self.raw) < n:
            part = self.stream.read(self.part)
            if not part:
                break
            self.raw += part
        return self.raw[:n]

    def more(self, most: int = 0) -> bool:
        """Adds a part to text, of `most` bytes if given; False at the end of the file."""
        if not self.zipped:
            part = self._peek(1) and self.raw
            self.raw, self.raw_at = b"", self.raw_at + len(part)
            self.text += part
            return bool(part)
        if self.inflate is None:
            if not self._peek(1):
                return False
            if self._peek(3) != MARK:
                raise self.fail("not a gzip member")
            self.at, self.inflate = self.raw_at, zlib.decompressobj(31)
            start = self._peek(24)
            self.said = struct.unpack("<I", start[16:20])[0] if len(start) == 24 and start[3] & 4 and start[12:14] == b"SL" else 0
        if not self._peek(1):
            raise self.fail("the file ends within it")
        try:
            new = self.inflate.decompress(self.raw, most or self.part)
        except zlib.error as e:
            raise self.fail(str(e)) from None
        rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.raw_at += len(self.raw) - len(rest)
        self.raw = rest
        self.inflated += len(new)
        self.text += new
        if self.inflate.eof:
            self.inflate = None
        return True

    def head(self) -> bytes | None:
        """A record's headers, without what ends them; None at the end of the file."""
        looked = 0
        while True:
            if not looked:
                self.text = self.text.lstrip(b"\r\n")  # between records
            k = self.text.find(b"\r\n\r\n", max(0, looked - 3))
            if self.text and k >= 0:
                out, self.text = self.text[:k], self.text[k + 4 :]
                if not out.startswith(b"WARC/"):
                    raise self.fail("not a WARC record")
                return out
            looked = len(self.text)
            if looked >= 5 and not self.text.startswith(b"WARC/"):
                raise self.fail("not a WARC record")
            if not self.more(1024):
                if self.text:
                    raise self.fail("the file ends within a header")
                return None

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if not self.text and not self.more():
                raise self.fail("the file ends within a record")
            part, self.text = self.text[: n - have], self.text[n - have :]
            parts.append(part)
            have += len(part)
        return b"".join(parts)

    def drop(self, n: int, head: int) -> None:
        """Leaves out n bytes, the block of a record whose headers took head bytes."""
        if n <= len(self.text):
            self.text = self.text[n:]
        elif not self.zipped:
            n -= len(self.text)
            self.text = b""
            ahead = n - len(self.raw)
            if ahead <= 0:
                self.raw, self.raw_at = self.raw[n:], self.raw_at + n
                return
            self.raw, self.raw_at = b"", self.raw_at + n
            # The last byte is read, so that a file that ends before it is noticed.
            self.stream.seek(ahead - 1, 1)
            if not self.stream.read(1):
                raise self.fail("the file ends within a record")
        elif not (self.inflate and self._skip(head + n + 4)):
            while n:
                if not self.text and not self.more():
                    raise self.fail("the file ends within a record")
                k = min(n, len(self.text))
                self.text = self.text[k:]
                n -= k

    def _skip(self, length: int) -> bool:
        """Goes to the end of the member, if it can be told that it holds just one record, of this length."""
        if self.said:
            place = self.at + self.said
            if place > self.raw_at + len(self.raw):
                self.stream.seek(place - 1)
                if not self.stream.read(1):
                    raise self.fail("the file ends within it")
                self.raw = b""
            else:
                self.raw = self.raw[place - self.raw_at :]
            self.raw_at = place
        elif self.alone:
            trailer = struct.pack("<I", length & 0xFFFFFFFF)
            place, held, back = self.raw_at, self.raw, self.raw_at
            while (k := held.find(trailer + MARK)) < 0:
                part = self.stream.read(1 << 20)
                if not part:
                    break
                place, held = place + max(0, len(held) - 6), held[-6:] + part
            # Its end, or that of the file; or it goes on with another record, and the search isn't made again.
            self.alone = k >= 0 or held.endswith(trailer)
            place = place + k + 4 if k >= 0 else place + len(held) if self.alone else back
            self.stream.seek(place)
            self.raw, self.raw_at = b"", place
            if not self.alone:
                return False
        else:
            return False
        self.text, self.inflate = b"", None
        return True


def read_records(stream, wanted, payloads: bool, name: str = "archive") -> Iterator[tuple[Headers, bytes | None]]:
    """(headers, payload) of the records whose headers are wanted."""
    source = stream if isinstance(stream, Source) else Source(stream, name)
    while (head := source.head()) is not None:
        headers = parsed(head)
        said = headers.find("Content-Length") or ""
        if not said.isdecimal():
            raise source.fail("a record without length")
        n, keep = int(said), wanted(headers)
        if keep and payloads and headers.find("WARC-Type") != "revisit":
            yield headers, _payload(source.take(n))
        else:
            source.drop(n, len(head) + 4)
            if keep:
                yield headers, None


@dataclass
class Archives(InputPartition):
    files: list


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.most = int(options.get("maxpartitionbytes", options.get("maxPartitionBytes", 64 << 20)))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in NAMED and isinstance(f, EqualTo):
                self.tests.append((NAMED[column], "in", (f.value,)))
            elif column in NAMED and isinstance(f, In):
                self.tests.append((NAMED[column], "in", tuple(f.value)))
            elif column in NAMED and isinstance(f, StringStartsWith):
                self.tests.append((NAMED[column], "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[Archives]:
        from pyarrow import fs

        system, path = file_system(self.path)
        listed = f"{path}/{MANIFEST}"
        if system.get_file_info(listed).type == fs.FileType.File:
            with system.open_input_stream(listed) as s:
                names = json.loads(s.read())
            infos = system.get_file_info([f"{path}/{x}" for x in names])
        else:
            infos = [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and (".warc" in x.base_name)]
        out: list[Archives] = []
        held = 0
        for x in sorted(infos, key=lambda x: x.path):
            if not out or held + x.size > self.most:
                out.append(Archives([]))
                held = 0
            out[-1].files.append(x.path)
            held += x.size
        return out or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        schema = pa.schema([*((c, pa.string()) for c in NAMED), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

        def wanted(headers: Headers) -> bool:
            return all((headers.find(name) in value) if how == "in" else (headers.find(name) or "").startswith(value) for name, how, value in self.tests)

        rows, held = [], 0
        for name in partition.files:
            with system.open_input_file(name) as stream:
                for headers, payload in read_records(stream, wanted, self.payloads, name):
                    rows.append({c: headers.find(h) for c, h in NAMED.items()} | {"headers": list(headers.items()), "payload": payload})
                    held += len(payload or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("maxfilebytes", options.get("maxFileBytes", 64 << 20)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        files: list[str] = []
        out, held = None, 0
        for b in iterator:
            for r in b.to_pylist():
                if out is None or held >= self.most:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, held = system.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                raw = member(record(r["record_type"], r["record_id"], r["target_uri"], r["payload_digest"], r["refers_to"], dict(r["headers"] or []), r["payload"]))
                out.write(raw)
                held += len(raw)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        names = [f for m in messages if m for f in m.files]
        listed = f"{path}/{MANIFEST}"
        if not self.overwrite and system.get_file_info(listed).type == fs.FileType.File:
            with system.open_input_stream(listed) as s:
                names = [*json.loads(s.read()), *names]
        with system.open_output_stream(listed, compression=None) as s:
            s.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = file_system(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(f"{path}/{f}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def records(pages: DataFrame, least: int = 100) -> DataFrame:
    """A record for each page (page_id, url, html).

    Of equal payloads of at least `least` bytes, that of the smallest page_id is
    the response and the others revisit it. Rows without page_id revisit a page
    that has one; a null html is an empty payload; rows that repeat a response's
    page_id are responses too. Only digests are gathered to find equal payloads."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", body.alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    firsts = p.filter(F.col("n") >= least).groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    firsts = firsts.filter("copies > 1").select("same", "first")
    j = p.join(firsts, p["digest"] == firsts["same"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    extra = F.map_filter(
        F.create_map(F.lit("X-Page-Id"), F.col("page_id").cast("string"), F.lit("X-Payload-Length"), F.col("n").cast("string")), lambda k, v: v.isNotNull()
    )
    return j.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        extra.alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def save(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(WarcSource)
    rows.write.format("warc").mode("append").save(path)


def load(spark, path: str, payloads: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def page_report(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records in path.

    A response's figures come from its payload as read; a revisit's from its headers."""
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    head = (F.col("headers")["X-Page-Id"].cast("long").alias("page_id"),)
    a = load(spark, path).filter("record_type = 'response'").select(
        *head, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    b = load(spark, path, payloads=False).filter("record_type = 'revisit'").select(
        *head, F.col("headers")["X-Payload-Length"].cast("long").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"))
    return a.unionByName(b)
