"""Importance resampling towards a target's distribution of hashed word n-grams.

Features of a text are its runs of one to three words, each hashed to a bucket. Two
passes over the texts, both in Arrow batches. The first counts buckets with
np.bincount into one vector a task; treeReduce adds these, so that one vector comes to
the driver. The target's are counted in the same way. From both follow the gains, one
number a bucket, which are broadcast: their size is that of the buckets, whatever the
tables hold. The second pass gathers the gains of each document's features and sums
them with np.bincount by document.

The sample is drawn by noise: weights get Gumbel noise from a hash of the id, and the
highest scores are drawn, which is drawing without replacement by weight. Ranks come
from a range sort of small rows and counts by partition; nothing else is gathered.

A run's CRC continues from that of the run before it, so that no run is joined. Long
texts are cut in pieces whose first runs continue from the words before.

Defined results: a null text has no words, so weight 0, and isn't drawn; texts with
fewer than `least_words` words aren't drawn and don't count in the share; an empty
target or table has counts of 0; a null id hashes as an empty one and comes last among
equal scores; rows are documents of their own, also if ids repeat, and rows equal in
score and id are told apart by their counts, then by place; no rows give none; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.words import PIECE, texts, words
from scriptorium.session import written

BUCKETS, NGRAM = 10_000, 3
#: Features that are held as numbers at a time.
HELD = 1 << 18


def hashes(raw: bytes, ngram: int = NGRAM, piece: int = PIECE) -> Iterator[list[int]]:
    """CRCs of all runs of 1 to ngram words of a text, in lists of the runs of one length within a piece; a run is in the piece of its last word."""
    last: list[list[int]] = [[] for _ in range(ngram - 1)]  # by length, the run that ends with the last word before
    for ws in words(raw, piece):
        runs, spaced = list(map(crc32, ws)), [b" " + w for w in ws]
        yield runs
        for n in range(1, ngram):
            left = [*last[n - 1], *runs]
            last[n - 1] = runs[-1:] or last[n - 1]
            runs = list(map(crc32, spaced[len(ws) - len(left) + 1 :], left))
            yield runs


def counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS, ngram: int = NGRAM) -> np.ndarray:
    """Features of all rows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(buckets, dtype=np.int64), [], 0
        for b in batches:
            for raw in texts(b, 0):
                for runs in hashes(raw, ngram):
                    held.append(np.array(runs, dtype=np.uint32))
                    n += len(runs)
                if n > HELD:
                    total += np.bincount(np.concatenate(held) % buckets, minlength=buckets)
                    held, n = [], 0
        if n:
            total += np.bincount(np.concatenate(held) % buckets, minlength=buckets)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    vectors = rows.select(text).mapInArrow(run, "v binary").rdd.map(lambda r: np.frombuffer(r[0], dtype=np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, dtype=np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, a thousand times the log of how much more often the target has it, with one more of each, rounded down."""
    n, m, k = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: (float(t + 1) * float(n + k)) / (float(s + 1) * float(m + k))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc: int | None, seed: int = 42) -> int:
    """A thousand times Gumbel noise of an id, rounded down."""
    h = int(sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text", seed: int = 42, ngram: int = NGRAM) -> DataFrame:
    """(id, n_words, n_features, weight, score)"""
    kind = docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for b in batches:
            weight, n_words, n_features = np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
            held, owner, n = [], [], 0

            def settle() -> np.ndarray:
                by = np.repeat(owner, [len(x) for x in held])
                return np.bincount(by, weights=gain[np.concatenate(held) % len(gain)], minlength=b.num_rows)

            for i, raw in enumerate(texts(b, 1)):
                for k, runs in enumerate(hashes(raw, ngram)):
                    if k % ngram == 0:
                        n_words[i] += len(runs)
                    n_features[i] += len(runs)
                    held.append(np.array(runs, dtype=np.uint32))
                    owner.append(i)
                    n += len(runs)
                    if n > HELD:
                        weight += settle()
                        held, owner, n = [], [], 0
            if n:
                weight += settle()
            weight = weight.astype(np.int64)
            score = weight + np.array([noise(d, seed) for d in b.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n_words, n_features, weight, score))], names=["id", "n_words", "n_features", "weight", "score"])

    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    return docs.select(id_col, text).mapInArrow(run, schema)


def drawn(rows: DataFrame, percent: int = 5, least_words: int = 20, id_col: str = "doc_id") -> DataFrame:
    """rows (id, n_words, n_features, weight, score) with rank: 1, 2, 3... for the highest scores of `percent` of
    the rows of enough words, else null. The rows are sorted in ranges; a number a partition gives where its ranks begin."""
    able = F.col("n_words") >= least_words
    rows = rows.withColumns({"__sc_able": able, "__sc_row": F.monotonically_increasing_id()})
    rows = written(rows)  # sorting samples its input first: it is made once
    order = [F.desc("__sc_able"), F.desc("score"), F.asc_nulls_last(id_col), F.col("n_features"), F.col("weight"), F.col("__sc_row")]
    placed = written(rows.orderBy(*order).withColumns({"__sc_part": F.spark_partition_id(), "__sc_place": F.monotonically_increasing_id()}))
    sizes = sorted(map(tuple, placed.filter("__sc_able").groupBy("__sc_part").agg(F.min("__sc_place"), F.count("*")).collect()))
    before, n = [], 0
    for part, first, k in sizes:
        before.append((part, n - first + 1))
        n += k
    offsets = rows.sparkSession.createDataFrame(before, "__sc_part int, __sc_before long")
    rank = F.col("__sc_place") + F.col("__sc_before")
    out = placed.join(F.broadcast(offsets), "__sc_part", "left").withColumn("rank", F.when(F.col("__sc_able") & (rank <= n * percent // 100), rank))
    return out.drop("__sc_able", "__sc_row", "__sc_part", "__sc_place", "__sc_before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, ngram: int = NGRAM, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of all docs, weighed by how near their features are to target's."""
    gain = gains(counts(docs, text, buckets, ngram), counts(target, text, buckets, ngram))
    return drawn(weighed(docs, gain, id_col, text, seed, ngram), percent, least_words, id_col)
