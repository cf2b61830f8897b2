"""Language-model scores from a lattice of subwords.

An existing subword vocabulary gives the arcs: a word, with the mark of its
beginning, is cut in every way into pieces, and the forward recursion in log
space sums the probability of all cuts. No piece spans two words, so a
document's marginal probability is the product over its words and its end.

The vocabulary's scores are the prior of the pieces' probabilities: scores that
are merge ranks count as a Zipf law over the rank, others as logarithms. One
step of expectation maximisation over the counts of all training words
(forward-backward, weighted by count) turns them to the corpus; `learn=False` leaves
the vocabulary's own. A word is scored once for the corpus, not once for each time it
occurs. A long word costs time and 16 bytes a character, however long it is.

Counts are gathered over all documents: per task first, then per word. To give
each document the counts and scores of its words, the commonest words, at most
`common` of them, are broadcast and looked up; only the rare rest is joined by a
shuffle. Rows are told apart by their place, so that repeated rows and null ids
each have a result.

Defined results: a null text is empty and holds just the end; a null id counts
as the empty text for the split; an empty table gives no rows; repeated rows each get
theirs; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import written

DEFAULT_VOCABULARY = "piece_bpe_32k.model"
#: The end of a document as a token: no word has white space.
END = "\n"
BEGIN = "▁"
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def words(text: str | None) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()]


def held_out(doc_id, parts: int = 5, rest: int = 1) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts == rest


@cache
def pieces(path: str) -> tuple[dict[str, int], dict[int, int], list[float]]:
    """Piece ids by text, those of bytes, and the prior logarithms of all (natural; -inf for control pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    text: dict[str, int] = {}
    byte: dict[int, int] = {}
    scores = {}
    for i in range(n):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[3:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            text[sp.id_to_piece(i)] = i
            scores[i] = sp.get_score(i)
    ranked = min(scores.values(), default=0) < -1000
    weight = {i: 1 / (10 - s) if ranked else math.exp(s) for i, s in scores.items()}
    total = sum(weight.values())
    prior = [-math.inf] * n
    for i, w in weight.items():
        prior[i] = math.log(w / total * 0.999)
    for i in byte.values():
        prior[i] = math.log(0.001 / len(byte))
    return text, byte, prior


@cache
def trie(path: str) -> dict:
    """The pieces of a file by character: a dictionary for each beginning, with the piece's id under 0."""
    root: dict = {}
    for s, i in pieces(path)[0].items():
        node = root
        for c in s:
            node = node.setdefault(c, {})
        node[0] = i
    return root


class Lattice:
    """All cuts of a word into pieces, with natural logarithms of probabilities for each piece."""

    #: Words of more characters are taken end by end, without a list of all their arcs.
    LONG = 1000

    def __init__(self, path: str, logs: list[float] | None = None):
        self.text, self.byte, prior = pieces(path)
        self.logs = prior if logs is None else logs
        self.longest = max(map(len, self.text), default=1)
        self.unseen = min((x for x in self.logs if x > -math.inf), default=-20.0)
        self.root = trie(path)

    def alone(self, character: str) -> tuple[float, tuple[int, ...]]:
        """A character without a piece goes by its bytes."""
        ids = tuple(self.byte[x] for x in character.encode("utf-8", "surrogatepass") if x in self.byte)
        return (sum(self.logs[x] for x in ids) if ids else 3 * self.unseen), ids

    def pushed(self, s: str, arcs: list[list] | None = None) -> tuple[list[float], list[list[float]]]:
        """Logarithms of what leads to each place of s, and their terms, one for each arc that
        ends there; arcs, if given, takes the (start, piece or pieces) of these."""
        exp, log, logs, root = math.exp, math.log, self.logs, self.root
        terms: list[list[float]] = [[] for _ in range(len(s) + 1)]
        terms[0].append(0.0)
        out = []
        for a in range(len(s) + 1):
            t = terms[a]
            if len(t) == 1:
                here = t[0]
            else:
                top = max(t)
                here = top + log(sum([exp(x - top) for x in t]))
            out.append(here)
            node, b = root, a
            for c in s[a : a + self.longest]:
                node = node.get(c)
                b += 1
                i = None if node is None else node.get(0)
                if i is not None:
                    terms[b].append(here + logs[i])
                    if arcs is not None:
                        arcs[b].append((a, i))
                elif b == a + 1:
                    w, ids = self.alone(c)
                    terms[b].append(here + w)
                    if arcs is not None:
                        arcs[b].append((a, ids))
                if node is None:
                    break
        return out, terms

    def ending(self, s: str, b: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """As arcs, for one end."""
        found = [(a, self.text[s[a:b]]) for a in range(max(0, b - self.longest), b) if s[a:b] in self.text]
        out = [(a, self.logs[i], (i,)) for a, i in found]
        return out if found and found[-1][0] == b - 1 else [*out, (b - 1, *self.alone(s[b - 1]))]

    def forward(self, ends: Iterable[list], keep: int) -> array:
        """Logarithms of what leads to each place, the last `keep` of them at least."""
        exp, log = math.exp, math.log
        out, gone = array("d", [0.0]), 0
        for end in ends:
            if len(end) == 1:
                a, w, _ = end[0]
                out.append(out[a - gone] + w)
            else:
                xs = [out[a - gone] + w for a, w, _ in end]
                top = max(xs)
                out.append(top + log(sum([exp(x - top) for x in xs])))
            if len(out) > 4 * keep:
                gone += len(out) - keep
                del out[:-keep]
        return out

    def log10(self, word: str) -> float:
        """Logarithm of the marginal probability of a word."""
        s = BEGIN + word
        if len(s) <= self.LONG:
            return self.pushed(s)[0][-1] / math.log(10)
        return self.forward((self.ending(s, b) for b in range(1, len(s) + 1)), max(self.LONG, self.longest))[-1] / math.log(10)

    def expected(self, word: str, weight: float, into: dict[int, float]) -> None:
        """Adds the expected number of times each piece is in a cut of word."""
        s = BEGIN + word
        n, exp, get = len(s), math.exp, into.get
        if n <= self.LONG:
            arcs: list[list] = [[] for _ in range(n + 1)]
            forward, terms = self.pushed(s, arcs)
            after = [0.0] * n + [1.0]  # of cuts of what follows a place, as a share of the whole
            for b in range(n, 0, -1):
                rest, at = after[b], forward[b]
                if rest == 0.0:
                    continue
                for (a, i), x in zip(arcs[b], terms[b], strict=True):
                    share = rest * exp(x - at)
                    after[a] += share
                    if type(i) is int:
                        into[i] = get(i, 0.0) + share * weight
                    else:
                        for k in i:
                            into[k] = get(k, 0.0) + share * weight
            return
        forward = self.forward((self.ending(s, b) for b in range(1, n + 1)), n + 1)
        after = array("d", bytes(8 * (n + 1)))
        after[n] = 1.0
        for b in range(n, 0, -1):
            rest, at = after[b], forward[b]
            if rest == 0.0:
                continue
            for a, w, ids in self.ending(s, b):
                share = rest * exp(forward[a] + w - at)
                after[a] += share
                for i in ids:
                    into[i] = get(i, 0.0) + share * weight


COUNTED = pa.schema([("word", pa.string()), ("c", pa.int64()), ("n", pa.int64())])


def counted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 300_000) -> DataFrame:
    """(word, c, n): occurrences in training documents and in all; END is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(c.keys() | held.keys())
            for i in range(0, len(keys), 20_000):
                k = keys[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "surrogatepass") for x in k], pa.string()), pa.array([c[x] for x in k], pa.int64()), pa.array([c[x] + held[x] for x in k], pa.int64())], schema=COUNTED)

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                into = held if held_out(i) else c
                into.update((x or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())
                into[b"\n"] += 1
                if len(c) + len(held) > most:
                    yield from out()
                    c.clear()
                    held.clear()
        yield from out()

    parts = docs.select(id_col, text).mapInArrow(run, "word string, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def learned(vocabulary: DataFrame, path: str, prior_tokens: float = 1000.0) -> tuple[list[float], float]:
    """Natural logarithms for each piece, and for the end, after one step over the training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, into = Lattice(path), {}
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lattice.expected(w, c, into)
        yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.int32()), pa.array(list(into.values()), pa.float64())], names=["piece", "e"])

    ends = vocabulary.filter(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    some = vocabulary.filter((F.col("word") != END) & (F.col("c") > 0)).select("word", "c")
    # At most one row for each piece of the vocabulary reaches the driver.
    rows = some.mapInArrow(run, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()
    prior = pieces(path)[2]
    e = dict(map(tuple, rows))
    total = sum(e.values()) + ends + 1 + prior_tokens
    logs = [math.log((e.get(i, 0.0) + prior_tokens * math.exp(p)) / total) if p > -math.inf else p for i, p in enumerate(prior)]
    return logs, math.log((ends + 1) / total)


def weighed(vocabulary: DataFrame, path: str, logs: list[float]) -> DataFrame:
    """(word, c, n, lp): lp is the log10 of the word's marginal probability."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, sent.value)
        for b in batches:
            lp = [lattice.log10(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lp, pa.float64())], names=[*b.schema.names, "lp"])

    return vocabulary.filter(F.col("word") != END).select("word", "c", "n").mapInArrow(run, "word string, c long, n long, lp double")


def commonest(vocabulary: DataFrame, common: int) -> DataFrame:
    """The words of at least the least count that at most `common` words reach."""
    by_count = vocabulary.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("words"))
    least, total = None, 0
    # A row for each count up to a million, most of which no word has.
    for n, k in by_count.orderBy(F.desc("n")).collect():
        if total + k > common:
            break
        least, total = n, total + k
    return vocabulary.filter(F.col("n") >= least) if least is not None else vocabulary.filter(F.lit(False))


def scores(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", common: int = 200_000, learn: bool = True) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per document."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text)
    vocabulary = written(counted(docs, id_col, text))
    seen = vocabulary.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1)), F.sum(F.when(F.col("word") == END, F.col("c")))).first()
    total, distinct, ends = (x or 0 for x in seen)
    logs, end = learned(vocabulary, path) if learn else (pieces(path)[2], math.log((ends + 1) / (total + 1)))
    end /= math.log(10)
    every = written(weighed(vocabulary, path, logs))
    # At most `common` words: their place, and by place their counts and logarithms.
    hot = commonest(every, common).select("word", "c", "lp").toArrow()
    places = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(hot.column("word").to_pylist())}
    sent = spark.sparkContext.broadcast((places, hot.column("c").to_numpy().astype(np.int64), hot.column("lp").to_numpy().astype(np.float64)))
    under = math.log10(total + 0.5 * (distinct + 1))
    base = lambda c: math.log10(c + 0.5) - under
    end_base, end_known = base(ends), int(ends > 0)

    fields = [("row", pa.int64()), ("id", pa.int64()), ("word", pa.string()), ("tf", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    schema = pa.schema(fields)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = schema.set(1, pa.field("id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, c, lp = sent.value
        get, bases, known = place.get, np.log10(c + 0.5) - under, c > 0
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out: list[tuple] = []
                for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    tokens = (x or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
                    found = list(map(get, tokens))
                    for w, tf in Counter([w for w, k in zip(tokens, found, strict=True) if k is None]).items():
                        out.append((row, None, w.decode("utf-8", "surrogatepass"), tf, 0, 0, 0.0, 0.0))
                    at_ = np.array([k for k in found if k is not None], dtype=np.int64)
                    # A key that is no word, one for each row, so that these rows spread.
                    out.append((row, i, f"\n{row}", 0, len(tokens) + 1, end_known + int(known[at_].sum()), end_base + float(bases[at_].sum()), end + float(lp[at_].sum())))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c_, f.type) for c_, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    parts = docs.mapInArrow(run, f"row long, id {kind}, word string, tf long, n_tokens long, n_known long, base double, score double")
    j = parts.join(every.select("word", "c", "lp"), "word", "left")
    # c and lp are null for the rows of whole documents only; their tf is 0.
    c = F.coalesce("c", F.lit(0))
    j = j.select(
        "row", "id", "n_tokens", (F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("tf") * (F.log10(c + 0.5) - F.lit(under))).alias("base"), (F.col("score") + F.col("tf") * F.coalesce("lp", F.lit(0.0))).alias("score"),
    )
    g = j.groupBy("row").agg(F.max("id").alias(id_col), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    return g.select(
        id_col, (F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
