"""The log of deltas against a plain dictionary; what is written, what a repeated batch does, what a failure leaves."""

import random
from datetime import datetime, timedelta

import pytest
from scriptorium.operators import store
from scriptorium.operators.upserts import Run, UpsertLog
from scriptorium.sources.files import listed, size_of

T0 = datetime(2024, 1, 1)
DDL = "device_id string, user_id string, recovery_hash string, created_at timestamp, last_seen_at timestamp"


def batch(rng, n, keys):
    at = lambda: T0 + timedelta(minutes=rng.randrange(5000))
    rows = []
    for _ in range(n):
        t = at()
        rows.append((f"d{rng.randrange(keys)}", rng.choice([None, "u1", "u2"]), rng.choice([None, "h"]), t, t))
    return rows


def plain(rows):
    out = {}
    for d, u, h, a, z in rows:
        got = out.setdefault(d, [None, None, None, None, a, z])  # user with its time, hash with its time, first, last
        if u is not None and (got[0] is None or (z, u) > got[0]):
            got[0] = (z, u)
        if h is not None and (got[1] is None or (z, h) > got[1]):
            got[1] = (z, h)
        got[4], got[5] = min(got[4], a), max(got[5], z)
    return {d: (g[0] and g[0][1], g[1] and g[1][1], g[4], g[5]) for d, g in out.items()}


def table(df):
    return {r["device_id"]: (r["user_id"], r["recovery_hash"], r["created_at"], r["last_seen_at"]) for r in df.collect()}


@pytest.mark.parametrize("fanout", [2, 3])
def test_reading_equals_a_dictionary_whatever_is_merged(spark, tmp_path, fanout):
    rng = random.Random(fanout)
    log = store.devices_log(spark, str(tmp_path / "log"), ranges=2, fanout=fanout)
    rows = []
    for i in range(7):
        new = batch(rng, 12, 9)
        rows += new
        assert log.add(spark.createDataFrame(new, DDL), i)
    assert table(log.read()) == plain(rows)
    assert [r.level for r in log.runs()] == {2: [2, 1, 0], 3: [1, 1, 0]}[fanout]
    some = sorted(plain(rows))[:2]
    assert table(log.find(some)) == {k: plain(rows)[k] for k in some}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    log = store.devices_log(spark, str(tmp_path / "log"), ranges=2, fanout=2)
    rng = random.Random(1)
    batches = [batch(rng, 5, 4) for _ in range(3)]
    for i, b in enumerate(batches):
        log.add(spark.createDataFrame(b, DDL), i)
    before, names = table(log.read()), listed(spark, log.path)
    for i, b in enumerate(batches):  # also those that are merged by now
        assert not log.add(spark.createDataFrame(b, DDL), i)
    assert table(log.read()) == before and listed(spark, log.path) == names


def test_what_is_written_follows_the_batch(spark, tmp_path):
    log = store.devices_log(spark, str(tmp_path / "log"), ranges=4, fanout=4)
    rng = random.Random(2)
    log.add(spark.createDataFrame(batch(rng, 30_000, 20_000), DDL), 0)
    large = size_of(spark, log.path)
    log.add(spark.createDataFrame(batch(rng, 5, 20_000), DDL), 1)
    assert size_of(spark, log.path) - large < large / 10


def test_runs_that_failed_or_were_replaced_do_not_count(spark, tmp_path):
    log = store.devices_log(spark, str(tmp_path / "log"), ranges=2, fanout=2)
    rng = random.Random(3)
    rows = []
    for i in range(2):
        new = batch(rng, 6, 4)
        rows += new
        log.add(spark.createDataFrame(new, DDL), i)
    want = table(log.read())
    assert want == plain(rows) and [r.name for r in log.runs()] == [Run(1, 0, 1).name]
    assert len(listed(spark, log.path)) == 3  # the two that were merged are still there for readers
    half = spark.createDataFrame(batch(rng, 6, 4), DDL)
    half.write.parquet(f"{log.path}/{Run(0, 2, 2).name}")
    (tmp_path / "log" / Run(0, 2, 2).name / "_SUCCESS").unlink()
    assert table(log.read()) == want
    new = batch(rng, 6, 4)
    assert log.add(spark.createDataFrame(new, DDL), 2)  # over what the failure left
    assert table(log.read()) == plain(rows + new)
    assert Run(0, 0, 0).name not in listed(spark, log.path)


def test_find_reads_only_its_ranges(spark, tmp_path):
    log = UpsertLog(spark, str(tmp_path / "log"), "k", "k string, n long", (("n", "max"),), ranges=8)
    log.add(spark.createDataFrame([(f"k{i}", i) for i in range(200)], "k string, n long"), 0)
    one = log.find(["k7"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in one.collect()] == [("k7", 7)] and "PartitionFilters: [" in plan and "__sc_range" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_log_and_rows_without_key(spark, tmp_path):
    log = store.devices_log(spark, str(tmp_path / "none"))
    assert log.read().count() == 0 and log.runs() == []
    log.add(spark.createDataFrame([(None, None, None, T0, T0)], DDL), 0)
    assert log.read().count() == 0 and not log.add(spark.createDataFrame([], DDL), 0)


def test_old_versions_of_the_store_go(spark, tmp_path):
    path = str(tmp_path / "store")
    tables = store.opened(spark, path)
    for i in range(1, 5):
        assert store.saved(spark, tables, path) == i
    assert store.versions(spark, path) == [3, 4] and listed(spark, path) == ["v3", "v4"]
    store.opened(spark, path)["devices"].count()
