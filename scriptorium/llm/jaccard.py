"""Near-duplicate documents by the Jaccard similarity of their word shingles, exactly.

Documents are linked where the sets of their shingles have a similarity of
`similarity` or more, and classes are what links connect. Candidates come from two
searches, and each is verified by the whole sets.

The first is that of `simhash`: fingerprints over the same shingles, and its pivot
tables for those within two bits. It finds copies and hardly edited ones, most of all
pairs, but not all: texts of a similarity of 0.8 can differ in a dozen bits, and no
key holds for so many. The second finds the rest, of what the first didn't connect.
No pair is lost: if
shingles have any fixed order, two sets that similar share one of their first
n - ceil(similarity * n) + 1, n being the size of each. Documents meet at these
first shingles. Two sets of n and m that similar share at least a = ceil(similarity
/ (1 + similarity) * (n + m)), so the first one they share is among the first
n - a + 1 and m - a + 1; pairs that meet there are verified by their whole sets.

The order takes rare shingles first, by a sketch of their counts, so that
passages that many documents have hardly ever bring two together; the sketch
decides what is compared, never what is found. Documents of the same words are
one node before either search. Where many nodes meet, each is compared with one of
them in the first round, and one node of each class with one of the others in the
next; then all pairs that meet and aren't connected yet are compared. So a large
class costs in proportion to its nodes as long as rounds connect it. A shingle that
the sketch takes to be in very many nodes is dealt in parts: the first round is within
these, the next has one node of each class, and a shingle whose nodes are connected
isn't looked at again; so a group of any size is in many tasks. Only where a shingle's
nodes stay in several classes after that are all of its rows in one task.

Defined results: words are those of a fingerprint; fewer words than a shingle make
one shingle; texts without words are alike. Nodes and shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.simhash import _LOWER, components, fingerprint, labelled, per_text
from scriptorium.llm.simhash import links as fingerprint_links
from scriptorium.session import cut, release

CELLS = 1 << 20
_CHUNK = 1 << 14
#: Up to so many rows of nodes to compare are broadcast; more are joined as Spark sees fit.
_SENT = 500_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def node_of(words: list[bytes]) -> int:
    from xxhash import xxh64_intdigest as h

    return int(np.uint64(h(b" ".join(words), 7)).astype(np.int64))


def shingles(words: list[bytes], size: int = 5) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    from xxhash import xxh64_intdigest as h

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([h(joined, 42)], np.uint64)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    return np.unique(np.array([h(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[size - 1 :], strict=False)], np.uint64))


def nodes(docs: DataFrame, id_col: str, text: str, shingle: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, node, fp): one row per document; fp is its fingerprint over the same shingles."""
    return per_text(docs, list(dict.fromkeys((id_col, *keep))), text, {"node": lambda x: node_of(words_of(x)), "fp": lambda x: fingerprint(x, shingle)})


def _once(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(node, shingles) by batch; a task's copies come once."""
    seen: set[int] = set()
    for b in batches:
        out = []
        for x in b.column(0).to_pylist():
            words = words_of(x)
            node = node_of(words)
            if node not in seen:
                seen.add(node)
                out.append((node, shingles(words, size)))
        yield out


def sketch(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Counts of shingles by cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for some in _once(batches, size):
            if some:
                total += np.bincount((np.concatenate([s for _, s in some]) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if total.any():
            parts = total.reshape(-1, _CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((CELLS // _CHUNK, _CHUNK), np.int64)
    for k, x in docs.select(text).mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary").collect():
        out[k] = np.frombuffer(x, np.int64)
    return np.minimum(out.reshape(-1), 2**31 - 1).astype(np.int32)


def first_shingles(docs: DataFrame, text: str, size: int, similarity: Fraction, most: int = 200_000) -> DataFrame:
    """(key, part, node, n, at): the shingles at which a node can meet one that similar, its number of shingles, and the place
    in their order. part is 0, but for shingles that more than `most` nodes may have, over the usual number: there it deals them."""
    counts = sketch(docs, text, size)
    usual = most + 4 * int(counts.sum(dtype=np.int64)) // CELLS
    sent = docs.sparkSession.sparkContext.broadcast((counts, -(-counts.astype(np.int64) // usual)))
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, parts_of = sent.value
        for some in _once(batches, size):
            keys, parts, own, sizes, places = [], [], [], [], []
            for node, s in some:
                n = len(s)
                k = n - -(-p * n // q) + 1
                if n:
                    cell = (s & np.uint64(CELLS - 1)).astype(np.int64)
                    first = np.lexsort((s, counts[cell]))[:k]
                    many = parts_of[cell[first]]
                    keys.append(s[first])
                    parts.append(np.where(many > 1, 1 + (node & 0x7FFFFFFF) % np.maximum(many, 1), 0).astype(np.int32))
                    own.append(np.full(k, node))
                    sizes.append(np.full(k, n, np.int32))
                    places.append(np.arange(k, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (parts, own, sizes, places))], names=["key", "part", "node", "n", "at"])

    return docs.select(text).mapInArrow(run, "key long, part int, node long, n int, at int")


def _whole(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, whose equal values stay together."""
    held: list[pa.RecordBatch] = []
    for b in (x for x in batches if x.num_rows):
        if sum(x.num_rows for x in held) >= rows and held[-1].column(0)[-1] != b.column(0)[0]:
            yield [np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(b.num_columns)]
            held = []
        held.append(b)
    if held:
        yield [np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(held[0].num_columns)]


def meeting(rows: DataFrame) -> DataFrame:
    """Rows (key, part, node, n, at), each once, of keys that several nodes have, and of all that are dealt in parts."""
    names = ["key", "part", "node", "n", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[list[np.ndarray], bool] | None = None  # the row before, and whether it was given
        for b in (x for x in batches if x.num_rows):
            columns = [c.to_numpy() for c in b.columns]
            if last:
                columns = [np.concatenate([x, y]) for x, y in zip(last[0], columns, strict=True)]
            key, part, node = columns[:3]
            new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (node[1:] != node[:-1]))
            given = bool(last and last[1])
            columns = [c[new] for c in columns]
            key, part = columns[:2]
            same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
            some = np.append(given, same) | np.append(same, False) | (part > 0)
            last = [c[-1:] for c in columns], bool(some[-1])
            some[0] &= not given
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], names=names)

    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(run, "key long, part int, node long, n int, at int")


def _near(similarity: Fraction, n: tuple[np.ndarray, np.ndarray], place: tuple[np.ndarray, np.ndarray], root: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which pairs of rows may be that similar, by their sizes and places, and aren't connected."""
    shared = -(-similarity.numerator * (n[0] + n[1]) // (similarity.numerator + similarity.denominator))  # at least, of two that similar
    return (root[0] != root[1]) & (place[0] <= n[0] - shared) & (place[1] <= n[1] - shared)


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def starred(rows: DataFrame, similarity: Fraction, turn: int) -> DataFrame:
    """(a, b): nodes of rows (key, part, node, n, at, root), each with one of its key: one that has the fewest
    shingles before it, as what others are edited from, and of several such another one each turn. From the second turn
    on, one node stands for all of a root at a key."""
    mixed = F.xxhash64("node", F.lit(turn)).alias("mixed")
    if turn:
        least = F.min(F.struct("at", mixed, "node", "n")).alias("m")
        rows = rows.groupBy("key", "root").agg(least).select("key", F.lit(0).alias("part"), "m.node", "m.n", "m.at", "root", "m.mixed")
    else:
        rows = rows.select("key", "part", "node", "n", "at", "root", mixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: list[np.ndarray] | None = None  # of the key that the last batch ended in
        for b in (x for x in batches if x.num_rows):
            columns = [b.column(i).to_numpy() for i in range(6)]
            if hub and hub[0][0] == columns[0][0] and hub[1][0] == columns[1][0]:
                columns = [np.concatenate([x, y]) for x, y in zip(hub, columns, strict=True)]
            key, part, node, n, place, root = columns
            n = n.astype(np.int64)
            new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            hub = [c[first[-1] : first[-1] + 1] for c in columns]
            ok = _near(similarity, (n, n[first]), (place, place[first]), (root, root[first]))
            if ok.any():
                yield _pairs(node[ok], node[first[ok]])

    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "at", "mixed").mapInArrow(run, "a long, b long").distinct()


def pairs(rows: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b): nodes of rows (key, node, n, at, root) that meet, may be that similar and have other roots."""
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, place, root in _whole(batches):
            order = np.lexsort((place, key))
            key, node, n, place, root = key[order], node[order], n[order].astype(np.int64), place[order], root[order]
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            sizes = np.diff(edges)
            left = np.repeat(edges[1:], sizes) - np.arange(len(key)) - 1
            shift, at = 1, np.flatnonzero(left >= 1)
            while len(at):
                other = at + shift
                ok = _near(similarity, (n[at], n[other]), (place[at], place[other]), (root[at], root[other]))
                if ok.any():
                    yield _pairs(node[at[ok]], node[other[ok]])
                shift += 1
                at = at[left[at] >= shift]

    return rows.join(several, "key").select("key", "node", "n", "at", "root").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def jobs(some: DataFrame, rows: DataFrame, most: int = 256) -> DataFrame:
    """(row, node, jobs): what the document that stands for a node has to do, jobs being (job, hub, first) structs.

    A pair is compared where its hub is, the node of the two with more pairs. A hub with
    more than `most` pairs has several jobs, so that no task has all of a large group."""
    ends = some.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    n = lambda c: ends.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    p = some.join(n("a"), "a").join(n("b"), "b")
    at_a = F.col("n_a") >= F.col("n_b")
    p = p.select(F.when(at_a, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(at_a, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("n_a", "n_b").alias("n"))
    p = p.withColumn("job", F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / most))))
    todo = p.select("job", "hub", "node").union(p.select("job", "hub", F.col("hub").alias("node")).distinct())
    by_node = todo.groupBy("node").agg(F.collect_set(F.struct("job", "hub")).alias("jobs"))
    return by_node.join(rows.groupBy("node").agg(F.min("__sc_row").alias("row")), "node").select("row", "node", "jobs")


def verified(docs: DataFrame, rows: DataFrame, text: str, size: int, some: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) that are that similar. Only the documents that stand for their nodes are cut into shingles,
    and a set travels once a job to the hub it is compared with."""
    p, q = similarity.numerator, similarity.denominator
    todo = cut(jobs(cut(some), rows))
    n = todo.limit(_SENT + 1).count()
    if not n:
        return cut(some.limit(0))
    wanted = docs.select(F.col("__sc_row").alias("row"), F.col(text).alias("text")).join(F.broadcast(todo) if n <= _SENT else todo, "row").select("text", "node", "jobs")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal rows stand for a node together
        for b in batches:
            jobs_, hubs, own, sets_ = [], [], [], []
            for x, node, todo_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                s = shingles(words_of(x), size).tobytes()
                for t in todo_:
                    jobs_.append(t["job"])
                    hubs.append(t["hub"] == node)
                    own.append(node)
                    sets_.append(s)
                    if len(sets_) * len(s) > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(jobs_, pa.int64()), pa.array(hubs, pa.bool_()), pa.array(own, pa.int64()), pa.array(sets_, pa.binary())], names=["job", "hub", "node", "s"])
                        jobs_, hubs, own, sets_ = [], [], [], []
            if sets_:
                yield pa.RecordBatch.from_arrays([pa.array(jobs_, pa.int64()), pa.array(hubs, pa.bool_()), pa.array(own, pa.int64()), pa.array(sets_, pa.binary())], names=["job", "hub", "node", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, hub, whole = None, 0, np.zeros(0, np.uint64)
        for b in batches:
            left, right = [], []
            for j, first, node, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if first:
                    job, hub, whole = j, node, s
                elif j == job:
                    shared = int((whole[np.minimum(np.searchsorted(whole, s), len(whole) - 1)] == s).sum()) if len(whole) else 0
                    if q * shared >= p * (len(whole) + len(s) - shared):
                        left.append(min(hub, node))
                        right.append(max(hub, node))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    sent = wanted.mapInArrow(spread, "job long, hub boolean, node long, s binary").repartition("job").sortWithinPartitions("job", F.desc("hub"))
    return cut(sent.mapInArrow(compare, "a long, b long").distinct())


def alike(rows: DataFrame) -> DataFrame:
    """(a, b): nodes of rows (node, fp) whose fingerprints are equal or linked, each with one node of a fingerprint."""
    nodes_ = rows.select("node", "fp").distinct()
    first = cut(nodes_.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    same = nodes_.join(first.filter("n > 1"), "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = fingerprint_links(first.select("fp"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    near = found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return same.union(near).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rowed(docs: DataFrame) -> DataFrame:
    """docs with a hash of each row, __sc_row, if it isn't there."""
    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    return docs if "__sc_row" in docs.columns else docs.withColumn("__sc_row", F.xxhash64(*own))


def links(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8, most_rounds: int = 2, rows: DataFrame | None = None, most: int = 200_000) -> DataFrame:
    """(a, b): nodes whose connection is that of all pairs that similar; rows, if given, has the docs' __sc_row, node and fp."""
    least = Fraction(str(similarity))
    if not 0 < least <= 1:
        raise ValueError("similarity is above 0, and 1 at most")
    docs = rowed(docs)
    rows = cut(nodes(docs, "__sc_row", text, shingle)) if rows is None else rows
    spark = docs.sparkSession
    found = verified(docs, rows, text, shingle, alike(rows), least)
    release(spark)  # the shuffles of each step before the next one's
    met = cut(meeting(first_shingles(docs, text, shingle, least, most)))
    release(spark)

    def unconnected() -> DataFrame:
        return met.join(cut(components(found)), "node", "left").withColumn("root", F.coalesce("root", "node"))

    for turn in range(most_rounds):
        found = found.union(verified(docs, rows, text, shingle, starred(unconnected(), least, turn), least))
        release(spark)
    return found.union(verified(docs, rows, text, shingle, pairs(unconnected(), least), least))


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, str]:
    """Rows (id, keep, node, fp), one per document; (node, root) of the nodes that have links; and the name node."""
    docs = rowed(docs)
    rows = cut(nodes(docs, id_col, text, shingle, tuple(dict.fromkeys((*keep, "__sc_row")))))
    found = links(docs, text, shingle, similarity, rows=rows)
    release(docs.sparkSession)  # those of the last pairs, before the rounds of classes
    roots = cut(components(found))
    release(docs.sparkSession)
    return rows, roots, "node"


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, node, component_id): one row per document; the class is named by its least id."""
    return labelled(*grouped(docs, id_col, text, shingle, similarity), id_col)
