"""Ranked search against plain scoring: shards and blocks of any size, ties, nulls, ids."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from scriptorium.llm import search
from scriptorium.llm.words import words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, queries, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, x in Counter(terms(text)).items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("shard", "pairs", "cells"), [(200, 12, 40), (1 << 20, 400_000, 1 << 22)])
def test_any_size_of_shards_and_blocks(spark, monkeypatch, shard, pairs, cells):
    rng = random.Random(7)
    some = [f"w{i}" for i in range(40)] + ["É", "ü1", "Aa", "aA"]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    docs += [(None, docs[3][1]), (None, docs[3][1]), (150, docs[3][1]), (3, docs[3][1]), (151, None), (152, "-- ,"), (153, "w1 " * 3000)]
    queries = [(i, " ".join(rng.choice([*some, "nowhere"]) for _ in range(rng.randint(0, 12)))) for i in range(25)] + [(None, "w1 W1 w2"), (4, "w1 w1"), (5, ""), (6, None), (7, docs[3][1])]
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, rank int, terms string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id int, text string, doc_id int")
    monkeypatch.setattr(search, "CELLS", cells)
    got = rows(search.search(search.index(d, shard_bytes=shard), q, k=5, pairs=pairs))
    assert got == brute(docs, queries, 5)


def test_row_groups_hold_few_shards(spark, tmp_path):
    d = spark.range(0, 250, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    search.index(d, path=str(tmp_path / "shards"), shard_bytes=1)
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "shards").glob("*.parquet")]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == 250 and max(groups) <= search.GROUP_SHARDS


def test_a_word_in_every_document_weighs_little_and_alone_nothing(spark):
    d = spark.createDataFrame([(i, "common") for i in range(2000)], "doc_id int, text string")
    q = spark.createDataFrame([("a", "common")], "item_id string, text string")
    assert search.weight(2000, 2000) == 0
    assert search.search(search.index(d), q).count() == 0


def test_ids_other_than_integers_are_refused(spark):
    with pytest.raises(TypeError):
        search.index(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


def test_best_keeps_the_first_of_ties():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(-2, 5, size=rng.integers(0, 30))
        want = sorted((i for i in range(len(s)) if s[i] > 0), key=lambda i: (-s[i], i))[:4]
        assert sorted(search.best(s, 4).tolist()) == sorted(want)


def test_words_by_pieces():
    rng = random.Random(1)
    for _ in range(300):
        raw = "".join(rng.choice(["a", "B", "é", " ", "\n", "-", "long" * 9]) for _ in range(rng.randint(0, 60))).encode()
        whole = [w for part in words(raw, 1 << 20) for w in part]
        assert whole == [t.encode() for t in terms(raw.decode())]
        for piece in (1, 2, 7, 20):
            assert [w for part in words(raw, piece) for w in part] == whole
