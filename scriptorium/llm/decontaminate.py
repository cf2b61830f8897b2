"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised byte by byte: A-Z become a-z, the other ASCII characters
that are neither letters nor digits become spaces, and bytes from 0x80 on stay
as they are. Words are what lies between spaces; joined by single spaces, with
one space before and one after, they make the string that is scanned once. The
place of each scanned word in the original text is known, which gives the spans of
hits in code points.

The automaton's patterns are the items, cut: an item shorter than a window is a
pattern whole; any other is cut into pieces of half a window's words, side by side,
so that the automaton has a node for each of its characters rather than one for each
character of each window. Every window holds a whole piece. Where a piece is found,
the text's windows around it, a fixed number, are looked up among the items' windows
by 128-bit hashes. Patterns lie within spaces, so that only whole words match.

The benchmark is a side of its own: it is read to the driver once, and broadcast in
blocks of at most `block_chars` characters (an item longer than that is a block
alone), each with one automaton. Texts are never shuffled. One block, 4,000,000
characters at most, takes about 400 MB in a worker. With more blocks, texts wait in
chunks while the automata are made one after the other, so that one is held at a time.

Defined results: null has no words; an item without words has no windows; items
with equal windows all count; a null item_id counts as a hit without being
named; repeated documents each get their row; an empty benchmark hits nothing; no
documents give no rows; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
HITS = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"
HIT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def normalised(text: str | None) -> bytes:
    """text in UTF-8, with as many bytes, folded to words and spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS)


def words(text: str | None) -> list[bytes]:
    return normalised(text).split()


def windows(item: list[bytes], size: int) -> list[bytes]:
    """The windows of an item's words; a shorter item is one window."""
    if not item:
        return []
    return [b" ".join(item[i : i + size]) for i in range(max(1, len(item) - size + 1))]


class Machine:
    """One automaton over the pieces of all items, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        import ahocorasick
        from xxhash import xxh3_128_digest

        self.size, self.half, self.digest = size, (size + 1) // 2, xxh3_128_digest
        self.items: dict[bytes, tuple] = {}  # of windows, by hash
        pieces: dict[bytes, list] = {}  # whether it is a piece of a longer item, and the items that it is whole
        for item_id, text in items:
            w = words(text)
            if 0 < len(w) < size:
                pieces.setdefault(b" ".join(w), [False, ()])[1] += (item_id,)
                continue
            for x in windows(w, size):
                key = self.digest(x)
                if item_id not in self.items.setdefault(key, ()):
                    self.items[key] += (item_id,)
            for i in range(0, len(w) - self.half + 1, self.half):
                pieces.setdefault(b" ".join(w[i : i + self.half]), [False, ()])[0] = True
        self.automaton = ahocorasick.Automaton()
        for x, (part, ids) in pieces.items():
            self.automaton.add_word(f" {x.decode('latin-1')} ", (x.count(b" ") + 1, part, ids))
        if pieces:
            self.automaton.make_automaton()

    def scan(self, folded: bytes) -> tuple[list[list[int]], set]:
        """Runs [first, last] of hit words in a normalised text, and the items found."""
        found = folded.split()
        if not found or not len(self.automaton):
            return [], set()
        joined = b" ".join(found)
        hits = list(self.automaton.iter(f" {joined.decode('latin-1')} "))
        if not hits:
            return [], set()
        begins = list(accumulate((len(w) + 1 for w in found), initial=0))
        size, half, n = self.size, self.half, len(found)
        ids: set = set()
        runs = []
        done = 0  # windows that begin before it were looked up
        for end, (length, part, whole) in hits:
            last = bisect_right(begins, end - 1) - 1
            if whole:
                runs.append([last - length + 1, last])
                ids.update(whole)
            if part:
                first = max(last - size + 1, done, 0)
                done = max(done, min(last - half + 1, n - size) + 1)
                for s in range(first, done):
                    got = self.items.get(self.digest(joined[begins[s] : begins[s + size] - 1]))
                    if got:
                        runs.append([s, s + size - 1])
                        ids.update(got)
        return joined_runs(runs), ids


def joined_runs(runs: list[list[int]]) -> list[list[int]]:
    """The runs in order, with those that touch made one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _spans(text: str, found: list[bytes], runs: list[list[int]]) -> list[dict]:
    """Word runs as code points of the original."""
    raw, folded = text.encode("utf-8", "surrogatepass"), normalised(text)
    at = 0
    begins, ends = [], []
    for w in found:
        at = folded.index(w, at)
        begins.append(at)
        at += len(w)
        ends.append(at)
    out, done, chars = [], 0, 0
    for a, b in runs:
        pair = []
        for place in (begins[a], ends[b]):
            chars += len(raw[done:place].decode("utf-8", "surrogatepass"))
            done = place
            pair.append(chars)
        out.append({"start": pair[0], "end": pair[1]})
    return out


_machines: dict = {}


def _machine(sent, size: int, stay: bool) -> Machine:
    """The automaton of a broadcast block; the only one stays for the worker's next tasks."""
    key, items = sent.value
    if not stay:
        return Machine(items, size)
    if (key, size) not in _machines:
        _machines.clear()
        _machines[key, size] = Machine(items, size)
    return _machines[key, size]


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items, read to the driver once, in blocks of a bounded size; one block at least."""
    held: list[tuple[str | None, str | None]] = []
    chars, given = 0, False
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if held and chars + len(text or "") > block_chars:
            yield held
            held, chars, given = [], 0, True
        held.append((item_id, text))
        chars += len(text or "")
    if held or not given:
        yield held


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", block_chars: int = 4_000_000, chunk_bytes: int = 64 << 20) -> DataFrame:
    """docs with one more column, __sc_hits (n_words, n_hit, item_ids, spans).

    With more than one block, texts wait in chunks of `chunk_bytes`."""
    spark = docs.sparkSession
    sent = []
    for items in blocks(benchmark, block_chars):
        key = hashlib.sha256(repr(sorted(items, key=repr)).encode()).hexdigest()
        sent.append(spark.sparkContext.broadcast((key, items)))
    names = docs.columns

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if len(sent) == 1 or sum(x.nbytes for x in held) >= chunk_bytes:
                yield held
                held = []
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            state: list[list[tuple]] = [[([], set())] * b.num_rows for b in chunk]
            for s in sent:
                machine = _machine(s, size, len(sent) == 1)
                for b, have in zip(chunk, state, strict=True):
                    for i, x in enumerate(b.column(text).to_pylist()):
                        runs, ids = machine.scan(normalised(x))
                        if runs:
                            have[i] = (joined_runs(have[i][0] + runs), have[i][1] | ids)
            for b, have in zip(chunk, state, strict=True):
                rows = []
                for x, (runs, ids) in zip(b.column(text).to_pylist(), have, strict=True):
                    found = words(x)
                    rows.append({"n_words": len(found), "n_hit": sum(q - p + 1 for p, q in runs), "item_ids": sorted(y for y in ids if y is not None), "spans": _spans(x, found, runs) if runs else []})
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, HIT)], names=[*names, "__sc_hits"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__sc_hits", T.StructType.fromDDL(HITS))])
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", size: int = 10) -> DataFrame:
    """(id, n_words, n_hit, item_ids, spans): one row per document."""
    return hits(docs.select(id_col, "text"), benchmark, size).select(id_col, "__sc_hits.*")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, unchanged."""
    return hits(docs, benchmark, size).filter("__sc_hits.n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
