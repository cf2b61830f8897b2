"""Membership of words in a large list, by a mergeable filter and a join for what it lets pass.

The filter is a bit array, two hashes of a word giving the places of its bits. It is built
by an aggregate: each task sets the bits of its words, 64 to a number, and numbers of one
place are merged by OR, so filters of parts add up to that of the whole. It goes to all
tasks if it is within a stated size; a larger one isn't built, and the join does all the
work. A word that the filter doesn't know isn't in the list; one that it lets pass mostly
is, and is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a filter that may be sent to all tasks, bits a word, and bits that a word sets.
MOST_BYTES, BITS, HASHES = 16 << 20, 12, 6


class MemberFilter:
    """2**power bits as numbers of 64; 12 bits a word let about one stranger in 200 pass."""

    def __init__(self, power: int, blocks: np.ndarray):
        self.power, self.blocks = power, blocks

    def __or__(self, other: MemberFilter) -> MemberFilter:
        if self.power != other.power:
            raise ValueError("filters of different sizes don't merge")
        return MemberFilter(self.power, self.blocks | other.blocks)

    def passes(self, words: Iterable[str]) -> np.ndarray:
        """Which of the words may be in the list."""
        from xxhash import xxh64_intdigest

        h = np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in words], dtype=np.uint64)
        out = np.ones(len(h), dtype=bool)
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            at = (low + np.uint64(i) * high) & np.uint64((1 << self.power) - 1)
            out &= (self.blocks[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def column(self, word: str, spark) -> Column:
        """Whether a word may be in the list; null isn't."""
        sent = spark.sparkContext.broadcast((self.power, self.blocks))

        def run(xs: pd.Series) -> pd.Series:
            out = MemberFilter(*sent.value).passes(xs.fillna("").tolist())
            return pd.Series(out & xs.notna().to_numpy())

        return F.pandas_udf(run, "boolean")(word)


def places(word: Column, power: int) -> Column:
    """The bits of a word."""
    h = F.xxhash64(word)
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return F.array(*[(low + i * high).bitwiseAND((1 << power) - 1) for i in range(HASHES)])


def power_of(n: int, most_bytes: int = MOST_BYTES) -> int | None:
    """The size of a filter for n words, None if it would be beyond most_bytes."""
    power = max(6, math.ceil(math.log2(max(1, n) * BITS)))
    return power if (1 << power) // 8 <= most_bytes else None


def member_filter(words: DataFrame, power: int, word: str = "word") -> MemberFilter:
    """The filter of these words. Tasks send numbers of which a bit is set, merged by place."""
    bit = words.select(F.explode(places(F.col(word), power)).alias("at"))
    merged = bit.groupBy(F.shiftright("at", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    blocks = np.zeros(1 << (power - 6), dtype=np.uint64)
    blocks[merged["block"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return MemberFilter(power, blocks)


def members(rows: DataFrame, words: DataFrame, word: str = "word", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows whose word is in the list (words, each once): only those that the filter lets pass are shuffled."""
    power = power_of(words.count(), most_bytes)
    if power is not None:
        rows = rows.filter(member_filter(words, power).column(word, rows.sparkSession))
    return rows.join(words.select(F.col("word").alias(word)), word, "left_semi")


def strangers(rows: DataFrame, words: DataFrame, word: str = "word", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows whose word isn't in the list: those that the filter doesn't know stay where they are, the others are joined."""
    known = words.select(F.col("word").alias(word))
    power = power_of(words.count(), most_bytes)
    if power is None:
        return rows.join(known, word, "left_anti")
    marked = rows.withColumn("__sc_may", member_filter(words, power).column(word, rows.sparkSession))
    may = marked.filter("__sc_may").drop("__sc_may").join(known, word, "left_anti")
    return marked.filter("NOT __sc_may").drop("__sc_may").unionByName(may)
