"""Ranked lexical search over a document-sharded index with integer impacts.

A shard is a row: the ids of some documents in order, its terms, and their postings
in CSR form (offsets; places of documents; impacts). An impact holds all of a
posting's score but the term's weight, which depends on how many documents of the
whole index hold the term, so that an index is made in one pass over the texts after
one that counts documents and terms, and no statistics of a vocabulary are joined or
broadcast. A shard takes a bounded number of bytes of text (one longer text is a shard).

Queries are cut into blocks of bounded size. For each block, one pass over the shards'
terms sums document frequencies, and one over the postings adds, a term at a time,
weight * occurrences * impact to dense accumulators of as many queries as fit; the k
best of a shard are taken by argpartition with ties by id, and merged with those that
the task had before. A task sends k rows a query, merged in two levels.

    score = sum over terms of occurrences * weight * impact
    weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    impact = 1000000000 tf div (1000 tf + 12 m), m = 75 + 25 n N div L

N documents have terms, L in all, n this one.

Defined results: a null text has no terms; a document without terms is in no result
and in no count; rows are documents of their own, and so are queries, also if ids
repeat; ids are integers, any other type is an error; a null id comes last among
equal scores; a query without terms has no rows, as has one none of whose terms is
there or weighs more than 0; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.llm.words import texts, words
from scriptorium.session import scratch

SHARD = "docs array<long>, terms array<string>, offsets binary, places binary, impacts binary"
#: Text bytes and documents of a shard; numbers in the accumulators of one step; (query, term) pairs of a block.
SHARD_BYTES, SHARD_DOCS, CELLS, PAIRS = 2 << 20, 1 << 16, 1 << 20, 400_000
#: Shards of a row group at most, which a writer or a reader holds at a time.
GROUP_SHARDS = 4
#: Groups of tasks whose results are merged before all are.
GROUPS = 16


@dataclass(frozen=True)
class Index:
    """Shards (a written table), documents with terms, and their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


class _Codes(dict):
    """Terms by number, in the order in which they are met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Shard:
    """Documents of one shard, as they come."""

    def __init__(self):
        self.codes, self.size = _Codes(), 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc: int | None, raw: bytes) -> None:
        found = [np.fromiter(map(self.codes.__getitem__, ws), np.int32, len(ws)) for ws in words(raw)]
        if not found:
            return
        terms, counts = np.unique(np.concatenate(found), return_counts=True)
        self.ids.append(doc)
        self.lengths.append(sum(map(len, found)))
        self.terms.append(terms)
        self.counts.append(counts)
        self.size += len(raw)

    def row(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        # Postings by document in order of ids; then stably by term.
        m = np.repeat(np.array([75 + 25 * self.lengths[i] * n_docs // n_terms for i in order], dtype=np.int64), [len(self.terms[i]) for i in order])
        place = np.repeat(np.arange(len(order), dtype=np.int32), [len(self.terms[i]) for i in order])
        term = np.concatenate([self.terms[i] for i in order])
        tf = np.concatenate([self.counts[i] for i in order]).astype(np.int64)
        by = np.argsort(term, kind="stable")
        impact = (1_000_000_000 * tf // (1000 * tf + 12 * m)).astype(np.int32)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.codes))))).astype(np.int64)
        names = pa.array(list(self.codes), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                pa.array([offsets.tobytes()], pa.binary()), pa.array([place[by].tobytes()], pa.binary()), pa.array([impact[by].tobytes()], pa.binary()),
            ],
            names=["docs", "terms", "offsets", "places", "impacts"],
        )


def index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, shard_bytes: int = SHARD_BYTES) -> Index:
    """An index of all docs, its shards written to path (else to the shared folder)."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} isn't an integer")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for raw in texts(b, 0):
                own = sum(map(len, words(raw)))
                n, total = n + (own > 0), total + own
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})

    n_docs, n_terms = rows.select(text).mapInArrow(count, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), texts(b, 1), strict=True):
                shard.add(doc, raw)
                if shard.size >= shard_bytes or len(shard.ids) >= SHARD_DOCS:
                    yield shard.row(n_docs, n_terms)
                    shard = _Shard()
        if shard.ids:
            yield shard.row(n_docs, n_terms)

    spark = docs.sparkSession
    path = path or scratch(spark, "shards")
    # Small row groups: a writer and a reader hold few shards at a time. Sizes alone don't see to that: a writer asks for
    # the size of its row group after a hundred rows first.
    rows.mapInArrow(run, SHARD).write.options(**{"parquet.block.size": 8 << 20, "parquet.block.row.count.limit": GROUP_SHARDS}).parquet(path)
    return Index(spark.read.schema(SHARD).parquet(path), n_docs, n_terms)


def _blocks(queries: DataFrame, id_col: str, text: str, pairs: int) -> DataFrame:
    """Queries with terms in rows of about `pairs` (query, term) pairs: ids, sizes, and the terms of each with their occurrences."""
    kind = queries.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(chain.from_iterable(words(raw))) for raw in texts(b, 1)]
            terms = pa.array([[t.decode() for t in c] for c in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), terms, pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["id", "terms", "counts"])

    each = queries.select(F.col(id_col).alias("id"), text).mapInArrow(cut, T.StructType([T.StructField("id", kind), *T._parse_datatype_string("terms array<string>, counts array<long>").fields])).filter(F.size("terms") > 0)
    total = each.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            ids, terms, counts = zip(*held, strict=True)
            names = ["ids", "sizes", "terms", "counts"]
            arrays = [pa.array([list(ids)], pa.list_(id_type)), pa.array([list(map(len, terms))], pa.list_(pa.int64())), pa.array([list(chain(*terms))], pa.list_(pa.string())), pa.array([list(chain(*counts))], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        size = 0
        for b in batches:
            id_type = b.schema.field(0).type
            for i, terms, counts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if held and size + len(terms) > pairs:
                    yield row()
                    held, size = [], 0
                held.append((i, terms, counts))
                size += len(terms)
        if held:
            yield row()

    parts = T.StructType([T.StructField("ids", T.ArrayType(kind)), *T._parse_datatype_string("sizes array<long>, terms array<string>, counts array<long>").fields])
    return each.coalesce(max(1, math.ceil(total / pairs))).mapInArrow(packed, parts)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, the first of equal ones."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        s = scores[at]
        least = s[np.argpartition(s, len(s) - k)[len(s) - k]]
        above = at[s > least]
        at = np.concatenate((above, at[s == least][: k - len(above)]))
    return at


class _Best:
    """The k best (score, id) of each query so far; null ids, marked, come last."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if query in self.held:
            scores, ids, null = (np.concatenate(x) for x in zip(self.held[query], (scores, ids, null), strict=True))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.held[query] = scores[order], ids[order], null[order]


def _frequencies(shards: DataFrame, terms: list[str]) -> np.ndarray:
    """Documents that hold each of terms, of which there are as many as a block has."""
    sent = shards.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, n = pa.array(sent.value, pa.string()), np.zeros(len(sent.value), dtype=np.int64)
        for b in batches:
            for names, offsets in zip(b.column(0), b.column(1), strict=True):
                t = pc.index_in(asked, value_set=names.values.cast(pa.string()))
                there = np.flatnonzero(t.is_valid())
                at, o = t.drop_null().to_numpy(), np.frombuffer(offsets.as_py(), dtype=np.int64)
                n[there] += o[at + 1] - o[at]
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"t": pa.array(there, pa.int32()), "n": pa.array(n[there], pa.int64())})

    out = np.zeros(len(terms), dtype=np.int64)
    for t, n in shards.select("terms", "offsets").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n")).collect():
        out[t] = n
    sent.destroy()
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _answered(ix: Index, block, k: int, kind: T.DataType) -> DataFrame:
    """(q, id, doc, score): the k best of each query of a block by every task, written."""
    spark = ix.shards.sparkSession
    terms = sorted(set(block["terms"]))
    weights = [weight(ix.n_docs, int(n)) if n else 0 for n in _frequencies(ix.shards, terms)]
    number = {t: i for i, t in enumerate(terms)}
    query = np.repeat(np.arange(len(block["sizes"])), block["sizes"])
    term, times = np.array([number[t] for t in block["terms"]]), np.array(block["counts"], dtype=np.int64)
    by = np.lexsort((query, term))  # the queries of each term, in order
    sent = spark.sparkContext.broadcast((terms, weights, query[by], times[by], np.searchsorted(term[by], np.arange(len(terms) + 1)), list(block["ids"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, query, times, edges, ids = sent.value
        asked, found = pa.array(terms, pa.string()), _Best(k)
        for b in batches:
            for docs, names, *parts in zip(*(b.column(i) for i in range(5)), strict=True):
                doc = docs.values
                null, number = np.asarray(doc.is_null()), np.asarray(doc.fill_null(0))
                offsets, places, impacts = (np.frombuffer(p.as_py(), dtype=d) for p, d in zip(parts, (np.int64, np.int32, np.int32), strict=True))
                at = pc.index_in(asked, value_set=names.values.cast(pa.string())).fill_null(-1).to_numpy()
                step = max(1, CELLS // len(doc))
                for first in range(0, len(ids), step):
                    acc = np.zeros((min(step, len(ids) - first), len(doc)), dtype=np.int64)
                    for t in np.flatnonzero(at >= 0).tolist():
                        a, z = edges[t] + np.searchsorted(query[edges[t] : edges[t + 1]], (first, first + step))
                        if a < z and weights[t]:
                            here = slice(offsets[at[t]], offsets[at[t] + 1])
                            gain = impacts[here].astype(np.int64) * weights[t]
                            for q, c in zip((query[a:z] - first).tolist(), times[a:z].tolist(), strict=True):
                                acc[q, places[here]] += gain * c
                    for q in range(len(acc)):
                        top = best(acc[q], k)
                        if len(top):
                            found.add(first + q, acc[q, top], number[top], null[top])
        for q, (scores, docs, null) in found.held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([q] * len(scores), pa.int32()), pa.array([ids[q]] * len(scores), id_type), pa.array(docs, pa.int64(), mask=null), pa.array(scores, pa.int64())], names=["q", "id", "doc", "score"]
            )

    id_type = to_arrow_type(kind)
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("id", kind), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())])
    rows = ix.shards.mapInArrow(run, schema).withColumn("part", F.spark_partition_id() % GROUPS)
    order = (F.desc("score"), F.asc_nulls_last("doc"))
    for keys in (("q", "part"), ("q",)):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    path = scratch(spark, "ranked")
    rows.select("id", "rank", "doc", "score").write.parquet(path)
    sent.destroy()
    return spark.read.schema(T.StructType([schema["id"], T.StructField("rank", T.IntegerType()), schema["doc"], schema["score"]])).parquet(path)


def search(ix: Index, queries: DataFrame, k: int = 20, id_col: str = "item_id", text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(id, rank, doc_id, score): the k best documents of each query. One block of queries at a time is on the driver and broadcast."""
    kind = queries.schema[id_col].dataType
    spark = queries.sparkSession
    out = spark.createDataFrame([], T.StructType([T.StructField("id", kind), *T._parse_datatype_string("rank int, doc long, score long").fields]))
    if ix.n_docs:
        for block in _blocks(queries, id_col, text, pairs).toLocalIterator():
            out = out.unionByName(_answered(ix, block, k, kind))
    return out.select(F.col("id").alias(id_col), "rank", F.col("doc").alias("doc_id"), "score")
