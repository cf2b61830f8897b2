"""Importance resampling against plain counting: pieces, empty tables, ties, nulls."""

import math
import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

from scriptorium.llm import resample

from tests.llm.test_search import terms


def features(text):
    w = terms(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20):
    crc = lambda f: crc32(f.encode()) % 10000
    s = Counter(crc(f) for _, t in docs for f in features(t))
    t = Counter(crc(f) for x in target for f in features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((float(t[k] + 1) * float(big_s + 10000)) / (float(s[k] + 1) * float(big_t + 10000))))
    out = []
    for i, x in docs:
        fs = features(x)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain(crc(f)) for f in fs)
        out.append([i, len(terms(x)), len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    rank = {id(r): n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r, rank.get(id(r))) for r in out), key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["alpha", "Beta", "é", "x1", "gamma", "delta"]) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_plain_counting(spark):
    docs = [*made(5, 130), (None, "alpha " * 30), (None, "beta " * 30), (7, "again " * 25), (7, "again " * 25), (500, None), (501, ""), (502, "-"), (503, "alpha " * 3000)]
    target = [t for _, t in made(9, 9)] + [None]
    d = spark.createDataFrame([(i, t, 0, "w") for i, t in docs], "doc_id long, text string, rank int, weight string").repartition(4)
    t = spark.createDataFrame([(t,) for t in target], "text string")
    assert rows(resample.resampled(d, t, percent=40)) == brute(docs, target, 40)


def test_pieces_continue():
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 25)))
        want = sorted(crc32(f.encode()) for f in features(text))
        for piece in (1, 3, 10, 1 << 20):
            assert sorted(h for runs in resample.hashes(text.encode(), piece=piece) for h in runs) == want


def test_long_texts_are_summed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(resample, "HELD", 50)
    docs, target = made(3, 40), ["alpha beta gamma"]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(resample.resampled(d, spark.createDataFrame([(t,) for t in target], "text string"))) == brute(docs, target)


def test_without_target_or_rows(spark):
    docs = made(4, 30)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(resample.resampled(d, d.limit(0), percent=10)) == brute(docs, [], 10)
    assert resample.resampled(d.filter("false"), d).count() == 0


def test_equal_rows_are_spread_and_ranked(spark):
    d = spark.createDataFrame([(None, "same " * 20)] * 300, "doc_id long, text string").repartition(5)
    got = resample.resampled(d, d.limit(1))
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 16))


def test_nearer_texts_are_drawn(spark):
    docs = [(i, ("target words are here " if i % 10 == 0 else "other things stand there ") * 10) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = resample.resampled(d, spark.createDataFrame([("target words are here",)] * 50, "text string"))
    assert {r["doc_id"] % 10 for r in got.filter("rank is not null").collect()} == {0}
