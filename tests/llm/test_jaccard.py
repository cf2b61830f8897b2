import random
from fractions import Fraction
from itertools import combinations

import corpus_pipeline
from scriptorium.llm import jaccard

from tests.llm.brute import connected, split


def shingles(text, size=5):
    w = split(text, lower=True)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b, least=(4, 5)):
    return a == b or len(a & b) * least[1] >= least[0] * len(a | b)


def planted():
    """Edited copies, chains of them, copies about the bound, a hub of many, and texts with a passage in common."""
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n in (30, 60, 200):
        for edits in range(0, 8):
            base = text(n)
            copy = list(base)
            for i in rng.sample(range(n), edits):
                copy[i] = "edited"
            rows += [" ".join(base), " ".join(copy).upper()]
    base = text(120)
    for i in range(60):  # each edited apart
        copy = list(base)
        copy[2 * i] = f"x{i}"
        rows.append(" ".join(copy))
    chain = text(100)
    for i in range(0, 40, 4):
        chain = [*chain[4:], *text(4)]
        rows.append(" ".join(chain))
    passage = text(40)
    rows += [" ".join([*text(45), *passage, *text(45)]) for _ in range(30)]
    rows += ["a b", "A  b", "a b c", "a b c d e", "a b c d e f", None, "", "\n"]
    return [(i, t) for i, t in enumerate(rows)] + [(None, rows[0]), (0, rows[0])]


def want(rows, least=(4, 5)):
    sets = [shingles(t) for _, t in rows]
    root = connected(range(len(rows)), [(i, j) for i, j in combinations(range(len(rows)), 2) if alike(sets[i], sets[j], least)])
    first = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[root[k]] = min(i, first.get(root[k], i))
    return sorted(((i, first.get(root[k])) for k, (i, _) in enumerate(rows)), key=repr)


def test_classes(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(((r[0], r[2]) for r in jaccard.classes(df).collect()), key=repr) == want(rows)


def test_rounds_and_parts_only_save_pairs(spark):
    """Without rounds, and with every shingle dealt in parts, what is connected is the same."""
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {jaccard.node_of(jaccard.words_of(t)): shingles(t) for _, t in rows}
    whole = connected(sorted(sets), [(a, b) for a, b in combinations(sorted(sets), 2) if alike(sets[a], sets[b])])
    for rounds, most in ((0, 200_000), (1, 200_000), (2, 1), (1, 5)):
        got = [(r["a"], r["b"]) for r in jaccard.links(df, most_rounds=rounds, most=most).collect()]
        assert connected(sorted(sets), got) == whole, (rounds, most)


def test_batches_of_any_size(spark):
    """Keys that go on over batches, down to a row each, meet and are compared as in one."""
    rng = random.Random(4)
    rows = [(rng.randrange(12), rng.choice([0, 0, 1]), rng.randrange(15), 10, rng.randrange(3)) for _ in range(150)]
    df = spark.createDataFrame(rows, "key long, part int, node long, n int, at int")
    by = {}
    for k, p, x, *_ in rows:
        by.setdefault((k, p), set()).add(x)
    want = sorted((k, p, x) for (k, p), xs in by.items() if len(xs) > 1 or p for x in xs)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        stars = []
        for size in ("1", "2", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            met = jaccard.meeting(df)
            assert sorted((r["key"], r["part"], r["node"]) for r in met.collect()) == want, size
            fixed = spark.createDataFrame(sorted({(k, p, x): (k, p, x, 10, 1, x) for k, p, x, *_ in rows}.values()), "key long, part int, node long, n int, at int, root long")
            stars.append([sorted((r["a"], r["b"]) for r in jaccard.starred(fixed, Fraction(1, 10), turn).collect()) for turn in (0, 1)])
        assert all(s == stars[-1] for s in stars) and all(stars[-1])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_likely_pairs_come_from_pivots_and_change_nothing(spark):
    """What the fingerprints propose is among their pairs, holds the exact copies' neighbours, and isn't trusted."""
    from scriptorium.llm.simhash import fingerprint

    rows = planted() + [(900, "a b c d e"), (901, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = {jaccard.node_of(jaccard.words_of(t)): fingerprint(t, 5) for _, t in rows}
    got = {(r["a"], r["b"]) for r in jaccard.alike(jaccard.nodes(df, "doc_id", "text")).collect()}
    near = {(a, b) for a, b in combinations(sorted(own), 2) if ((own[a] ^ own[b]) & (1 << 64) - 1).bit_count() <= 2}
    assert got and connected(sorted(own), got) == connected(sorted(own), near)
    wrong = spark.createDataFrame([(min(p), max(p)) for p in combinations(sorted(own)[:6], 2)], "a long, b long")
    docs = jaccard.rowed(df)
    sets = {jaccard.node_of(jaccard.words_of(t)): shingles(t) for _, t in rows}
    for some in (wrong, wrong.limit(0)):
        got = {(r["a"], r["b"]) for r in jaccard.verified(docs, jaccard.nodes(docs, "__sc_row", "text"), "text", 5, some, Fraction(4, 5)).collect()}
        assert got == {(r["a"], r["b"]) for r in some.collect() if alike(sets[r["a"]], sets[r["b"]])}


def test_large_hubs_are_split(spark):
    """A hub's pairs in several jobs are compared as in one."""
    rows = planted()
    df = jaccard.rowed(spark.createDataFrame(rows, "doc_id long, text string"))
    own = sorted({jaccard.node_of(jaccard.words_of(t)) for _, t in rows})
    some = spark.createDataFrame([(min(own[0], x), max(own[0], x)) for x in own[1:]] + [(own[1], own[2])], "a long, b long")
    nodes = jaccard.nodes(df, "__sc_row", "text")
    for most in (1, 7, 1000):
        got = jaccard.jobs(some, nodes, most).collect()
        assert sorted(r["node"] for r in got) == own and all(j["hub"] == own[0] or r["node"] in own[1:3] for r in got for j in r["jobs"])
        by = {}
        for r in got:
            for j in r["jobs"]:
                by.setdefault(j["job"], []).append(r["node"] == j["hub"])
        assert all(sum(x) == 1 for x in by.values()) and sum(len(x) - 1 for x in by.values()) == len(own)


def test_stage_drops_planted_near_copies(spark, sf):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, sf).collect() if r["doc_id"] is not None)
    assert kept == sorted({c for i, c in want(rows) if i is not None})


def test_empty(spark):
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
