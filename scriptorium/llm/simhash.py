"""Near-duplicate documents by SimHash fingerprints, searched with pivot tables.

A document's fingerprint has 64 bits, each set where over half of the hashes of
its word shingles have it. Documents are linked where fingerprints differ in at
most two bits, and classes are what links connect.

Equal fingerprints are one row before any search, so copies cost nothing. For
the others, the Hamming distances to a table of reference fingerprints, the
pivots, are computed once: the origin and, for each quarter of the bits, a set of
masks inside it. By the triangle inequality, two fingerprints within two bits
have no coordinate that differs by more than two; and since two bits touch at
most two quarters, the coordinates of two whole quarters, taken relative to the
origin's, are then equal. So the six pairs of quarters key the search: rows of
equal coordinates meet, pairs whose coordinates differ by more than two anywhere
are discarded, and the survivors are verified by their exact distance.

A key with more than `split` rows, counted beforehand, is keyed again by further
pivots, those of eighths: two bits that differ in the other two quarters touch at
most two of their four eighths, so rows meet by the coordinates of the two others.
Such a key holds at most 2^16 different fingerprints, however many rows share the
first one. Within a task, a key of more than `many` rows is split in the same way by
pivots of half that size, down to keys that can't hold more. Nothing is compared by
another method, and no key is gathered in one task. A key gives at most one link for
each of its fingerprints, to the least of its connected ones, so links stay in
proportion to fingerprints. Classes come from rounds of large and small stars over
links, each kept in the shared folder; links that don't settle in `most_rounds`
rounds (they halve distances, so 60 are never met) are an error, never cut short.

Defined results: a text without words has fingerprint zero; fewer words than a
shingle make one shingle; a null text has no words; null ids have no part in the
least id of a class, and a class of such rows alone has a null id; repeated rows
each get their row; an empty table gives no rows. Of a class, `representatives`
keeps one row, the one of the least id, rows without id last; of several rows with
that id, the one whose columns hash least; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.session import cut

QUARTERS = 4
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [h(joined, 42)]
    else:
        ends = list(accumulate(map((1).__add__, map(len, words))))
        starts = [0, *ends[:-1]]
        hashes = [h(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        some = np.array(hashes[i : i + 65_536], dtype="<u8")
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def per_text(docs: DataFrame, names: list[str], text: str, values: dict[str, Callable[[str | None], int]]) -> DataFrame:
    """The columns names of docs, and a column of 64-bit integers for each of values of the text."""
    docs = docs.select(*names, F.col(f"`{text}`").alias("__sc_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            new = [pa.array([f(x) for x in texts], pa.int64()) for f in values.values()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *new], names=[*names, *values])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in values)]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), shingle: int = 3) -> DataFrame:
    """(id, keep, fp): one row per document."""
    return per_text(docs, [id_col, *keep], text, {"fp": lambda x: fingerprint(x, shingle)})


def masks(size: int) -> list[int]:
    """For each k below size, the places whose number has an even count of ones in
    common with k. Their distances to size bits tell any two such apart."""
    return [sum(1 << i for i in range(size) if (i & k).bit_count() % 2 == 0) for k in range(size)]


def pivots() -> list[int]:
    """The origin, then the masks of each quarter."""
    size = 64 // QUARTERS
    return [0, *(m << (q * size) for q in range(QUARTERS) for m in masks(size))]


def coordinates(fp: np.ndarray, start: int, size: int) -> np.ndarray:
    """Distances to the masks of `size` bits from `start` on, relative to the origin's: a row for each fingerprint."""
    whole = np.bitwise_count(fp).astype(np.int8)
    return np.stack([np.bitwise_count(fp ^ np.uint64(m << start)).astype(np.int8) - whole for m in masks(size)], axis=1)


#: Quarters that a key of each pair leaves free, as (start, size).
FREE = [[(64 // QUARTERS * q, 64 // QUARTERS) for q in range(QUARTERS) if q not in p] for p in combinations(range(QUARTERS), 2)]


def finer(fp: np.ndarray, free: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Keys of fingerprints that differ at most in the two free blocks: those are
    halved, and two of the four halves key the rows, whose other two stay free."""
    halves = [(start + k * size // 2, size // 2) for start, size in free for k in range(2)]
    at = [coordinates(fp, *h) for h in halves]
    for kept in combinations(range(4), 2):
        key = np.full(len(fp), sum(1 << k for k in kept), np.uint64)
        with np.errstate(over="ignore"):
            for column in np.concatenate([at[k] for k in kept], axis=1).T:
                key = (key ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
        yield key.view(np.int64), [h for k, h in enumerate(halves) if k not in kept]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distances(fp: Column) -> list[Column]:
    return [F.bit_count(fp.bitwiseXOR(F.lit(signed(p)))) for p in pivots()]


def table_of_pivots(nodes: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, at): at has the distance to each pivot, a byte each."""
    return nodes.select(F.col(fp).alias("fp"), F.array(*[d.cast("byte") for d in distances(F.col(fp))]).alias("at"))


def keyed(table: DataFrame) -> DataFrame:
    """(pair, key, fp, at): key hashes the coordinates of two quarters relative to the origin's."""
    size = 64 // QUARTERS
    relative = lambda q: [F.col("at")[1 + q * size + k] - F.col("at")[0] for k in range(size)]
    keys = [F.struct(F.lit(n).alias("pair"), F.xxhash64(F.lit(n), *relative(p), *relative(q)).alias("key")) for n, (p, q) in enumerate(combinations(range(QUARTERS), 2))]
    return table.select("fp", "at", F.explode(F.array(*keys)).alias("k")).select("k.pair", "k.key", "fp", "at")


class Forest:
    """Union of rows of an array, with the least row as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flat(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.flat()
            a, b = up[a], up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def compare(forest: Forest, rows: np.ndarray, key: np.ndarray, fp: np.ndarray, at: np.ndarray, free: np.ndarray, blocks: list, most_bits: int, many: int) -> None:
    """Joins the rows of a forest that share a key and are within most_bits; free says which of blocks each key leaves free."""
    n = len(key)
    order = np.lexsort((fp, key))
    rows, key, fp, at, free = rows[order], key[order], fp[order], at[order], free[order]
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), n)
    sizes = np.diff(edges)
    # Blocks of one bit can't be halved; their keys hold four fingerprints.
    split = (sizes > many) & np.array([blocks[f][0][1] > 1 for f in free[edges[:-1]]], dtype=bool)
    left = np.repeat(edges[1:], sizes) - np.arange(n) - 1  # rows of the same key that follow
    few = np.repeat(~split, sizes)
    shift = 1
    some = np.flatnonzero(few & (left >= shift))
    while len(some):
        near = some[(np.abs(at[some] - at[some + shift]) <= most_bits).all(axis=1)]
        close = near[np.bitwise_count(fp[near] ^ fp[near + shift]) <= most_bits]
        forest.join(rows[close], rows[close + shift])
        shift += 1
        some = some[left[some] >= shift]
    for k in np.flatnonzero(split):
        part = slice(edges[k], edges[k + 1])
        for own, rest in finer(fp[part], blocks[free[edges[k]]]):
            compare(forest, rows[part], own, fp[part], at[part], np.zeros(len(own), np.int8), [rest], most_bits, many)


def linked(key: np.ndarray, fp: np.ndarray, at: np.ndarray, most_bits: int = 2, many: int = 512, free: np.ndarray | None = None, blocks: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, least fp) of the rows that share a key; without blocks, all 64 bits are free."""
    if blocks is None:
        free, blocks = np.zeros(len(key), np.int8), [[(0, 32), (32, 32)]]
    order = np.lexsort((fp, key))  # the least row of a key is its least fingerprint
    key, fp, at, free = key[order], fp[order], at[order], free[order]
    forest = Forest(len(key))
    compare(forest, np.arange(len(key)), key, fp, at, free, blocks, most_bits, many)
    up = forest.flat()
    some = np.flatnonzero(up != np.arange(len(key)))
    return fp[some], fp[up[some]]


#: What keys leave free: those of pairs of quarters, then those keyed again by eighths.
_BLOCKS = [*FREE, *(rest for free in FREE for _, rest in finer(np.zeros(1, np.uint64), free))]


def keyed_again(rows: DataFrame) -> DataFrame:
    """rows (pair, key, fp, at) with the coordinates of eighths in their keys: six rows for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, key = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            fp = b.column(2).to_numpy().view(np.uint64)
            for p in np.unique(pair).tolist():
                some = np.flatnonzero(pair == p)
                part = b.take(pa.array(some))
                for k, (own, _) in enumerate(finer(fp[some], FREE[p])):
                    with np.errstate(over="ignore"):
                        mixed = (own.view(np.uint64) ^ key[some]) * np.uint64(0xC2B2AE3D27D4EB4F)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), len(FREE) + 6 * p + k, np.int32)), pa.array(mixed.view(np.int64)), part.column(2), part.column(3)], names=["pair", "key", "fp", "at"])

    return rows.select("pair", "key", "fp", "at").mapInArrow(run, "pair int, key long, fp long, at array<byte>")


def links(nodes: DataFrame, most_bits: int = 2, split: int = 50_000, sent: int = 100_000) -> DataFrame:
    """(a, b): fingerprints whose connection is that of all links within most_bits.

    Keys of more than `split` rows are keyed again; up to `sent` of them are broadcast to
    find their rows, more are joined as Spark sees fit."""
    if not 0 <= most_bits <= 2:
        raise ValueError("the keys hold for at most two bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            free, key = (np.concatenate([b.column(i).to_numpy() for b in some]) for i in (0, 1))
            fp = np.concatenate([b.column(2).to_numpy() for b in some]).astype(np.int64).view(np.uint64)
            at = np.concatenate([b.column(3).flatten().to_numpy() for b in some]).reshape(len(key), -1).astype(np.int8)
            a, b = linked(key, fp, at, most_bits, free=free, blocks=_BLOCKS)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for b in (x for x in batches if x.num_rows):
            # A key's rows stay together.
            if sum(x.num_rows for x in held) >= 50_000 and held[-1].column(1)[-1] != b.column(1)[0]:
                yield out(held)
                held = []
            held.append(b)
        if held:
            yield out(held)

    # Fingerprints are small, their coordinates and keys aren't: all tasks share in making them.
    # The pair of quarters is part of the hash in key.
    spread = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    rows = keyed(table_of_pivots(spread))
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > split).select("key"))
    n_hot = hot.limit(sent + 1).count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= sent else hot
        rows = rows.join(hot, "key", "left_anti").select("pair", "key", "fp", "at").union(keyed_again(rows.join(hot, "key", "left_semi")))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def round_of_few(e: DataFrame, parts: int) -> DataFrame:
    """(a, b, moved): a large and a small star over links (a, b) with b < a, all links of a node in one of `parts` partitions.

    moved is false everywhere only if the links were stars of their least nodes before, which the round then gives back."""
    dealt = lambda df: df.repartition(parts, "a").distinct()
    least = F.min("b").over(Window.partitionBy("a"))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = dealt(e.select(F.explode(ways).alias("e")).select("e.a", "e.b")).withColumn("m", F.least("a", least))
    large = dealt(both.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"), F.expr("m < a").alias("moved"))).withColumn("m", least)
    return large.select(F.expr("if(b = m, a, b)").alias("a"), F.col("m").alias("b"), F.expr("moved or b <> m").alias("moved"))


def round_of_many(e: DataFrame) -> DataFrame:
    """(a, b): the same round, by joins that Spark can split, dealt as the session says."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    return small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60, a_part: int = 250_000, most_parts: int = 20) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): the root is the least node connected.

    Large-star and small-star rounds; only least neighbours are aggregated, never
    lists of them, and a hub's links are joined back to one row, which Spark can split.
    Up to `most_parts` times `a_part` links are dealt over no more partitions than they
    need, and twice a round, without joins: a round over few links takes tasks, files and log
    lines in proportion to its stages, not to them. The rounds are the same."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    parts = -(-e.count() // a_part)
    state = None
    for _ in range(most_rounds):
        if parts <= most_parts:
            e = cut(round_of_few(e, max(1, parts)))
            settled = e.filter("moved").isEmpty()
        else:
            e = cut(round_of_many(e))
            now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            settled, state = now == state, now
        if settled:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most_bits: int = 2, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, str]:
    """Rows (id, keep, fp), one per document; (node, root) of the fingerprints that have links; and the name fp."""
    rows = cut(fingerprints(docs, id_col, text, keep))
    return rows, cut(components(links(rows.select("fp").distinct(), most_bits))), "fp"


def firsts(rows: DataFrame, roots: DataFrame, key: str, first: Column) -> tuple[DataFrame, DataFrame]:
    """(key, root) of all keys of rows, and (root, first): the least of a column in each class."""
    named = rows.groupBy(key).agg(F.min(first).alias("first")).join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))
    return named.select(key, "root"), named.groupBy("root").agg(F.min("first").alias("first"))


def labelled(rows: DataFrame, roots: DataFrame, key: str, id_col: str) -> DataFrame:
    """(id, key, component_id): one row per row; the class is named by its least id."""
    named, least = firsts(rows, roots, key, F.col(id_col))
    label = named.join(least, "root").select(key, F.col("first").alias("component_id"))
    return rows.join(label, key).select(id_col, key, "component_id")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most_bits: int = 2) -> DataFrame:
    """(id, fp, component_id): one row per document; the class is named by its least id."""
    return labelled(*grouped(docs, id_col, text, most_bits), id_col)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", by: Callable[..., tuple[DataFrame, DataFrame, str]] = grouped) -> DataFrame:
    """One row of docs for each class, unchanged.

    by: gives the classes, as grouped does. Rows are told apart by a hash of their
    columns (those of map type aside); equal rows are one."""
    names = docs.columns
    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    marked = docs.withColumn("__sc_row", F.xxhash64(*own))
    rows, roots, key = by(marked, id_col, text, keep=("__sc_row",))
    cells = rows.groupBy(key, id_col, "__sc_row").agg(F.count("*").alias("n"))
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("__sc_id"), F.col("__sc_row").alias("__sc_first"), F.col("n").alias("__sc_n"))
    best = cut(firsts(cells, roots, key, first)[1].select("first.__sc_id", "first.__sc_first", "first.__sc_n"))
    kept = marked.join(best, marked[id_col].eqNullSafe(F.col("__sc_id")) & (F.col("__sc_row") == F.col("__sc_first")))
    out = kept
    if best.filter("__sc_n > 1").limit(1).count():  # equal rows: only these are made one, the others stay where they are
        out = kept.filter("__sc_n = 1").union(kept.filter("__sc_n > 1").dropDuplicates([id_col, "__sc_row"]))
    return out.select(*[F.col(f"`{c}`") for c in names])
