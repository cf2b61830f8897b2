"""Removal of passages that a document of a smaller id holds, by difference-cover anchors.

A passage is a window of `window` consecutive words. Hashing every window of a
corpus and shuffling it is what this avoids: with a difference cover of a period
v, any two positions have an offset below v that brings both to cover positions,
so two equal windows share an anchor of window - v + 1 words that begins at a
cover position in both documents. Four steps:

1. Anchors are hashed at cover positions only. What a task knows to be in two of
   its own documents is settled there; the rest is asked for by hash, once a
   hash and task, so a passage of millions of copies is one entry a task.
2. Anchors found in two documents go back to their documents.
3. There each is extended to the windows around it, and these, a small part of
   all, are hashed in full. The least id of each window is found in the same way.
4. Documents drop the words of windows that a smaller id has.

Entries travel packed, a row for a bucket of hashes and a task, and no hash, pair
or group is gathered beyond its bucket. Documents are dealt by a hash of their
id, once, for steps 3 and 4.

Defined results: null or short texts have no windows; words are what lies
between ASCII white space; ids are integers, any other type is an error; a null id is
neither smaller nor greater than another, so such rows keep all their words, and are
dealt by their place, over all tasks; rows of one id aren't compared with each other;
no rows give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: kind of an entry: asked for, known to be in two documents, or settled and on its way to its document.
ASK, KNOWN, SETTLED = 0, 1, 2
PACKED = "bucket int, kind int, keys binary, docs binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
RESULT = "n_words long, n_removed long, kept string"
#: Bytes of a key. Anchors only propose, so that 40 bits beside the bucket's do; windows decide, by 64 beside the bucket's.
ANCHOR, WINDOW = 5, 8


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A least set of residues whose differences give every residue."""
    for n in range(1, period + 1):
        for rest in combinations(range(1, period), n - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise AssertionError


class Text:
    """The words of a text, and slices of them joined by one space."""

    def __init__(self, text: str):
        self.words = text.encode("utf-8", "surrogatepass").split()
        self.n = len(self.words)

    def index(self) -> None:
        self.joined = b" ".join(self.words)
        ends = list(accumulate(map((1).__add__, map(len, self.words))))
        self.ends = ends
        self.starts = [0, *ends[:-1]]

    def anchors(self, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors."""
        from xxhash import xxh3_64_intdigest as h

        size = window - period + 1
        at = np.arange(max(0, self.n - size + 1))
        at = at[np.isin(at % period, difference_cover(period))]
        joined, starts, ends = self.joined, self.starts, self.ends
        return at, np.array([h(joined[starts[i] : ends[i + size - 1] - 1]) for i in at.tolist()], dtype=np.uint64)

    def windows(self, at: np.ndarray, window: int) -> np.ndarray:
        """Hashes of the windows at these places: 64 bits for the bucket, and 64 as key."""
        from xxhash import xxh3_128_digest as h

        joined, starts, ends = self.joined, self.starts, self.ends
        raw = b"".join([h(joined[starts[i] : ends[i + window - 1] - 1]) for i in at.tolist()])
        return np.frombuffer(raw, dtype=">u8").reshape(-1, 2).astype(np.uint64)


def _edges(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, in sorted entries, and their number at the end."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.append(np.flatnonzero(new), len(keys))


def _sorted(bucket: np.ndarray, keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by bucket, key and document without repeats, and the edges of equal bucket and key."""
    order = np.lexsort((docs, keys, bucket))
    bucket, keys, docs = bucket[order], keys[order], docs[order]
    other = np.ones(len(keys), dtype=bool)
    other[1:] = (bucket[1:] != bucket[:-1]) | (keys[1:] != keys[:-1])
    new = other.copy()
    new[1:] |= docs[1:] != docs[:-1]
    bucket, keys, docs, other = bucket[new], keys[new], docs[new], other[new]
    return bucket, keys, docs, np.append(np.flatnonzero(other), len(keys))


def _doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    """As doc_bucket(), for arrays: the same mixing of the id's bits."""
    x = docs.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) & np.uint64(0x7FFFFFFF)
    return ((x * np.uint64(48271)) % np.uint64(2147483647) % np.uint64(buckets)).astype(np.int32)


def doc_bucket(column: str, buckets: int):
    x = F.col(column).bitwiseXOR(F.shiftrightunsigned(F.col(column), 31)).bitwiseAND(F.lit(0x7FFFFFFF))
    return F.coalesce((x * 48271) % 2147483647 % buckets, F.monotonically_increasing_id() % buckets).cast("int")


def _pack(kind: int, bucket: np.ndarray, keys: np.ndarray, docs: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Entries as rows, one for each bucket, in the order given or, if settled, by document.

    Byte planes of sorted numbers compress well in a shuffle."""
    if not len(bucket):
        return
    order = np.lexsort((docs, bucket)) if kind == SETTLED else np.argsort(bucket, kind="stable")
    bucket, keys, docs = bucket[order], keys[order], docs[order]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    plane = lambda x, n: np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()
    rows = [(int(bucket[a]), kind, plane(keys[a:b], width), plane(docs[a:b], 8) if kind != KNOWN else b"") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    for i in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_pylist([dict(zip(_PACKED.names, r, strict=True)) for r in rows[i : i + 2000]], schema=_PACKED)


def _unpack(raw: bytes, width: int, dtype) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(dtype).ravel()


def _entries(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind, keys and docs of packed rows."""
    kinds, keys, docs = [np.zeros(0, np.int8)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in rows:
        keys.append(_unpack(r["keys"], width, np.uint64))
        docs.append(_unpack(r["docs"], 8, np.int64) if r["docs"] else np.zeros(len(keys[-1]), np.int64))
        kinds.append(np.full(len(keys[-1]), r["kind"], np.int8))
    return np.concatenate(kinds), np.concatenate(keys), np.concatenate(docs)


def _shared(hashes: np.ndarray, docs: np.ndarray, buckets: int, doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 1 of a task: anchors in one of its documents are asked for; the others are known."""
    bits = np.uint64(8 * ANCHOR)
    bucket, keys, docs, edges = _sorted(((hashes >> bits) % np.uint64(buckets)).astype(np.int32), hashes & ((np.uint64(1) << bits) - np.uint64(1)), docs)
    if not len(keys):
        return
    sizes = np.diff(edges)
    one = np.repeat(sizes == 1, sizes)
    first = edges[:-1][sizes > 1]
    yield from _pack(ASK, bucket[one], keys[one], docs[one], ANCHOR)
    yield from _pack(KNOWN, bucket[first], keys[first], docs[first], ANCHOR)
    yield from _pack(SETTLED, _doc_bucket(docs[~one], doc_buckets), keys[~one], docs[~one], ANCHOR)


def _least(hashes: np.ndarray, docs: np.ndarray, buckets: int, doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 3 of a task: only its least document of a window can be without a smaller one."""
    bucket, keys, docs, edges = _sorted((hashes[:, 0] % np.uint64(buckets)).astype(np.int32), hashes[:, 1], docs)
    if not len(keys):
        return
    first = np.zeros(len(keys), dtype=bool)
    first[edges[:-1]] = True
    yield from _pack(ASK, bucket[first], keys[first], docs[first], WINDOW)
    yield from _pack(SETTLED, _doc_bucket(docs[~first], doc_buckets), keys[~first], docs[~first], WINDOW)


def _answer(rows: list[dict], doc_buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """All asked for in one bucket: anchors in two documents, or windows in a smaller one."""
    kind, keys, docs = _entries([r for r in rows if r["kind"] != SETTLED], width)
    if not len(keys):
        return
    order = np.lexsort((docs, keys))
    kind, keys, docs = kind[order], keys[order], docs[order]
    edges = _edges(keys)
    sizes = np.diff(edges)
    if width == WINDOW:
        good = docs > np.repeat(docs[edges[:-1]], sizes)
    else:
        ask, far = kind == ASK, np.iinfo(np.int64)
        known = np.add.reduceat((~ask).astype(np.int64), edges[:-1]) > 0
        low = np.minimum.reduceat(np.where(ask, docs, far.max), edges[:-1])
        high = np.maximum.reduceat(np.where(ask, docs, far.min), edges[:-1])
        good = np.repeat(known | (high > low), sizes) & ask
    yield from _pack(SETTLED, _doc_bucket(docs[good], doc_buckets), keys[good], docs[good], width)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Packed rows, sorted by bucket, a bucket at a time."""
    at, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != at and rows:
                yield at, rows
                rows = []
            at = r["bucket"]
            rows.append(r)
    if rows:
        yield at, rows


def _answered(asked: DataFrame, parts: int, doc_buckets: int, width: int) -> DataFrame:
    """Entries for documents, by the bucket of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            settled = [r for r in rows if r["kind"] == SETTLED]
            if settled:
                yield pa.RecordBatch.from_pylist(settled, schema=_PACKED)
            yield from _answer(rows, doc_buckets, width)

    return asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, PACKED)


def _by_doc(hits: pa.Table, width: int) -> dict[int, np.ndarray]:
    _, keys, docs = _entries(hits.select(_PACKED.names).to_pylist(), width)
    order = np.argsort(docs, kind="stable")
    keys, docs = keys[order], docs[order]
    edges = np.append(np.flatnonzero(np.append(True, docs[1:] != docs[:-1])), len(docs)) if len(docs) else [0]
    return {int(docs[a]): keys[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)}


def _covered(at: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words a window at one of these places covers."""
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    return np.cumsum(mark[:n]) > 0


def removed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 13, period: int = 7, flush: int = 1_500_000) -> DataFrame:
    """(id, n_words, n_removed, kept): one row per document; kept: the other words, joined by one space."""
    if not 1 < period < window:
        raise ValueError("1 < period < window")
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} isn't an integer column: {docs.schema[id_col].dataType.simpleString()}")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    # A share of the entries for each task that grows with neither the corpus nor its groups.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    doc_buckets = 2 * parts

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, held = [], [], 0
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not x:
                    continue
                t = Text(x)
                if t.n < window:
                    continue
                t.index()
                h = t.anchors(window, period)[1]
                hashes.append(h)
                ids.append(np.full(len(h), i, np.int64))
                held += len(h)
                if held >= flush:
                    yield from _shared(np.concatenate(hashes), np.concatenate(ids), parts, doc_buckets)
                    hashes, ids, held = [], [], 0
        if held:
            yield from _shared(np.concatenate(hashes), np.concatenate(ids), parts, doc_buckets)

    def extend(table: pa.Table, hits: pa.Table) -> pa.Table:
        found, hashes, ids = _by_doc(hits, ANCHOR), [], []
        reach, low = np.arange(period), np.uint64((1 << 8 * ANCHOR) - 1)
        if found:
            for i, x in zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True):
                if i not in found or not x:
                    continue
                t = Text(x)
                if t.n < window:
                    continue
                t.index()
                at, h = t.anchors(window, period)
                at = at[np.isin(h & low, found[i])]
                places = np.unique((at[:, None] - reach).ravel())
                places = places[(places >= 0) & (places <= t.n - window)]
                if len(places):
                    hashes.append(t.windows(places, window))
                    ids.append(np.full(len(places), i, np.int64))
        if not ids:
            return _PACKED.empty_table()
        return pa.Table.from_batches(list(_least(np.concatenate(hashes), np.concatenate(ids), parts, doc_buckets)), schema=_PACKED)

    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def drop(table: pa.Table, hits: pa.Table) -> pa.Table:
        found, rows = _by_doc(hits, WINDOW), []
        for i, x in zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True):
            t = Text(x or "")
            gone, words = 0, t.words
            if i is not None and i in found and t.n >= window:
                t.index()
                places = np.arange(t.n - window + 1)
                hit = np.isin(t.windows(places, window)[:, 1], found[i])
                covered = _covered(places[hit], t.n, window)
                gone = int(covered.sum())
                words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            rows.append((i, t.n, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
        return pa.Table.from_pylist([dict(zip(out.names, r, strict=True)) for r in rows], schema=out)

    dealt = docs.withColumn("bucket", doc_bucket("id", doc_buckets))
    first = _answered(docs.mapInArrow(find, PACKED), parts, doc_buckets, ANCHOR)
    asked = dealt.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(extend, PACKED)
    second = _answered(asked, parts, doc_buckets, WINDOW)
    result = dealt.groupBy("bucket").cogroup(second.groupBy("bucket")).applyInArrow(drop, f"id long, {RESULT}")
    return result.withColumnRenamed("id", id_col)
