"""Line dedup against plain counting, and its runs: levels, merges, what is common."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from scriptorium.llm import linededup

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(docs, least=10, shortest=1):
    n = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if len(k) >= shortest)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < shortest or n[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(seed, n):
    rng = random.Random(seed)
    common = ["Home", " home\t", "Ä", "ä", "x" * 300, "", " ", "end\r", "END", "é "]
    return [(i, "\n".join(rng.choice([*common, f"own {rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_plain_counting_with_any_batches(spark, batches, fanout):
    docs = [*made(1, 60), (None, "Home\nz"), (None, "Home\nz"), (3, "twice\ntwice"), (3, "twice\ntwice"), (61, None), (62, ""), (63, "\n\n"), (64, "long line " * 5000), (65, "Home\n" * 4000)]
    d = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, gone string, a int").repartition(3)
    assert rows(linededup.deduplicated(d, least=4, batches=batches, fanout=fanout)) == brute(docs, 4)


def test_shortest_keys(spark):
    docs = made(2, 50)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(linededup.deduplicated(d, least=3, shortest=5)) == brute(docs, 3, 5)


@pytest.mark.parametrize("name", ["x", "gone", "a", "batch"])
def test_ids_and_texts_of_any_name(spark, name):
    docs = made(6, 30)
    d = spark.createDataFrame(docs, f"{name} long, keys string")
    assert rows(linededup.deduplicated(d, least=3, id_col=name, text="keys", batches=2)) == brute(docs, 3)


def test_no_rows(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.deduplicated(d).columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert linededup.deduplicated(d).count() == 0


def counts(spark, pairs):
    return spark.createDataFrame([(k, -k, n) for k, n in pairs.items()], "a long, b long, docs long")


def test_runs_merge_by_level_and_know_what_is_common(spark):
    runs = linededup.Runs(spark, least=5, fanout=2)
    for i in range(5):
        runs.add(counts(spark, {1: 2, 2: 5 if i == 0 else 1, 10 + i: 1}))
        assert all(len(level) < 2 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # five is binary 101
    # 2 was common from the first batch on and isn't counted again; 1 is since the third.
    whole = {r["a"]: r["docs"] for level in runs.levels for t in level for r in spark.table(t).filter("common").collect()}
    assert whole == {1: 8, 2: 5}
    tables = [t for level in runs.levels for t in level]
    assert sorted(r["a"] for r in runs.finished().collect()) == [1, 2]
    assert not [t for t in tables if spark.catalog.tableExists(t)]


def test_runs_are_joined_without_an_exchange(spark):
    runs = linededup.Runs(spark, least=2, fanout=9)
    runs.add(counts(spark, {i: 1 + i % 2 for i in range(50)}))
    runs.add(counts(spark, {i: 1 for i in range(20, 90)}))
    (x, y) = (spark.table(t) for t in runs.levels[0])
    plan = x.join(y.hint("merge"), linededup.KEY, "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(r["a"] for r in runs.finished().collect()) == sorted([i for i in range(50) if i % 2] + [i for i in range(20, 50) if i % 2 == 0])


def test_lower_case_of_ascii_only(spark):
    df = spark.createDataFrame([("ABC",), ("ÄBC",), ("İ",), ("",)], "x string")
    assert [r[0] for r in df.select(linededup.lowered(F.col("x"))).collect()] == ["abc", "Äbc", "İ", ""]
