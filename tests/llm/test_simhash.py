from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from scriptorium.llm import simhash
from xxhash import xxh64_intdigest

from tests.llm.brute import connected, split


def brute_fingerprint(text):
    words = split(text, lower=True)
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", "  \t\n", "one", "ONE", "two words", "a b c", "A  B\nC", "a b c d", "é ü ß x " * 50, "x" * 5000, " ".join(map(str, range(3000)))]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == brute_fingerprint(t)


def test_pivots_tell_quarters_apart():
    """Coordinates relative to the origin's determine the bits of a quarter."""
    masks = simhash.pivots()[1:17]
    seen = {tuple((x ^ m).bit_count() - x.bit_count() for m in masks) for x in range(1 << 16)}
    assert len(seen) == 1 << 16


@pytest.mark.parametrize("many", [512, 40, 1])
def test_links_within_a_key(many):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[b ^ (np.uint64(1) << rng.integers(0, 20, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 60, dtype=np.uint64)) for b in base]]))
    at = np.array([[(int(x) ^ p).bit_count() for p in simhash.pivots()] for x in fp], dtype=np.int8)
    a, b = simhash.linked(np.zeros(len(fp), np.int64), fp, at, 2, many)
    near = [(int(x), int(y)) for x, y in combinations(fp, 2) if (int(x) ^ int(y)).bit_count() <= 2]
    nodes = list(map(int, fp))
    assert connected(nodes, list(zip(map(int, a), map(int, b), strict=True))) == connected(nodes, near)


def rows_of(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    long = "the quick brown fox jumps over the lazy dog and runs away from all of them again and again " * 8
    extra = [(10_000 + i, f"{long} w{i}") for i in range(40)] + [(20_000, None), (20_001, ""), (20_002, "x"), (20_003, "x"), (20_003, "x"), (None, "x"), (None, "only here without id")]
    return docs + extra


def test_classes(spark, sf):
    rows = rows_of(spark, sf)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit("clash")})
    got = simhash.classes(df).collect()
    assert len(got) == len(rows)
    prints = {t: brute_fingerprint(t) for _, t in rows}
    nodes = sorted(set(prints.values()))
    root = connected(nodes, [(x, y) for x, y in combinations(nodes, 2) if (x ^ y).bit_count() <= 2])
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
    want = sorted(((i, prints[t], least.get(root[prints[t]])) for i, t in rows), key=repr)
    assert sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got), key=repr) == want


def kept_of(rows, classes):
    """One row of each class: least id, rows without id last; equal rows are one."""
    named = {}
    for row, c in zip(rows, classes, strict=True):
        named.setdefault(c, set()).add(row)
    return named


def test_representatives(spark, sf):
    rows = rows_of(spark, sf)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.representatives(df).collect()]
    prints = {t: brute_fingerprint(t) for _, t in rows}
    nodes = sorted(set(prints.values()))
    root = connected(nodes, [(x, y) for x, y in combinations(nodes, 2) if (x ^ y).bit_count() <= 2])
    named = kept_of(rows, [root[prints[t]] for _, t in rows])
    assert len(kept) == len(named)
    for i, t in kept:
        own = named.pop(root[prints[t]])
        assert (i, t) in own and i == min((x for x, _ in own if x is not None), default=None)


def test_representatives_are_rows(spark):
    """Rows of one id don't depend on each other, nor on equal rows elsewhere."""
    a, b, c = ("alpha beta gamma delta", "one two three four five", "red green blue")
    rows = [(3, a, "x"), (7, b, "x"), (7, a, "x")]
    get = lambda rows: sorted(map(tuple, simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()))
    assert get(rows) == [(3, a, "x"), (7, b, "x")]
    assert get([*rows, (9, c, "x"), (9, c, "x")]) == [(3, a, "x"), (7, b, "x"), (9, c, "x")]
    assert len(get([*rows, (3, a, "y"), (2, a, None)])) == 2


def test_hot_keys_are_split(spark):
    """One key's rows, beyond the bound on each side of it, keep all links."""
    rng = np.random.default_rng(2)
    fixed = np.uint64(0x1234_5678_0000_0000)
    fp = np.unique(np.concatenate([fixed ^ rng.integers(0, 1 << 32, 300, dtype=np.uint64), *[fixed ^ np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 32, 40, dtype=np.uint64)) for _ in range(3)]]))
    values = [int(x) for x in fp.view(np.int64)]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = connected(values, [(x, y) for x, y in combinations(values, 2) if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2])
    for split, sent in ((len(values), 10), (len(values) - 1, 10), (5, 1), (5, 100)):
        got = [(r["a"], r["b"]) for r in simhash.links(df, split=split, sent=sent).collect()]
        assert connected(values, got) == want, split


def test_empty(spark):
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("a_part", [250_000, 10, 40])
def test_chain_is_one_component(spark, a_part):
    """On each side of the bound to which links are dealt over few partitions."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges, a_part=a_part, most_parts=5).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
    assert simhash.components(edges.limit(0), a_part=a_part).count() == 0


def test_rounds_over_few_links_are_few_stages(spark):
    """Of links that are repeated or lead to hubs, classes are right on both ways; and over few links rounds have few stages."""
    rng = np.random.default_rng(6)
    some = [tuple(map(int, x)) for x in rng.integers(0, 400, (330, 2))]
    links = [*some, *some[:50], *[(7, i) for i in range(500, 560)]]
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    edges = spark.createDataFrame(links, "a long, b long")
    want = connected(nodes, [(a, b) for a, b in links if a != b])
    assert {r["node"]: r["root"] for r in simhash.components(edges, a_part=10).collect()} == want
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "components")
    try:
        found = simhash.components(edges)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in seen.getJobIdsForGroup("few") for s in seen.getJobInfo(j).stageIds}
    ran = sum(1 for s in stages if (x := seen.getStageInfo(s)) and x.numCompletedTasks)
    assert {r["node"]: r["root"] for r in found.collect()} == want
    assert ran <= 30, ran
