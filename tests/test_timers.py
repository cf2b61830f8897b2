"""Streams whose state ends: over files batch by batch, against the forms for tables."""

import random
from datetime import datetime, timedelta

import pytest
from scriptorium.operators import limits
from scriptorium.streaming import timers

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    timers.on_disk(spark)
    count = [0]

    def run(rows_by_batch, ddl, step):
        """All output of `step` over batches of rows, and the checkpoint."""
        d = tmp_path_factory.mktemp("stream")
        count[0] += 1
        name = f"timers_{count[0]}"
        for i, rows in enumerate(rows_by_batch):
            spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{d}/in/b={i}")
            for part in (d / "in" / f"b={i}").glob("part-*"):
                part.rename(d / f"{i:03}.parquet")
        (d / "files").mkdir()
        import os
        import time

        for i, f in enumerate(sorted(d.glob("*.parquet"))):
            g = d / "files" / f.name
            f.rename(g)
            os.utime(g, (time.time() - 100 + i, time.time() - 100 + i))
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(d / "files"))
        q = step(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(d / "ckpt")).start()
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive
        return spark.table(name).collect(), str(d / "ckpt")

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


EVENTS = "event_id long, user_id long, ts timestamp"


def events(seed, n, users=3, spread=200):
    rng = random.Random(seed)
    times = sorted(rng.randrange(spread * 1000) for _ in range(n))
    return [(i, rng.randrange(users), START + timedelta(milliseconds=t)) for i, t in enumerate(times)]


def closing(last):
    """An event of a user of its own, long after: the watermark passes all others."""
    return [(10_000, 99, last + timedelta(days=1))]


def test_limits_equal_the_table_form_and_idle_state_goes(spark, streamed):
    rows = events(1, 120)
    got, ckpt = streamed([rows[:40], rows[40:80], rows[80:], closing(rows[-1][2])], EVENTS, lambda s: timers.limited(s, 5, 10, "0 seconds"))
    want = limits.limited(spark.createDataFrame(rows, EVENTS), 5, 10)
    key = lambda r: (r["event_id"], r["accepted"])
    assert sorted(key(r) for r in got if r["user_id"] != 99) == sorted(map(key, want.collect()))
    left = spark.read.format("statestore").option("stateVarName", "times").load(ckpt).collect()
    assert {r["key"]["user_id"] for r in left} <= {99}


def test_late_requests_within_the_delay_are_judged_and_later_ones_dropped(streamed):
    at = lambda s: START + timedelta(seconds=s)
    first = [(1, 1, at(100)), (2, 1, at(101))]
    late = [(3, 1, at(99)), (4, 1, at(60)), (5, 2, at(99))]  # one window, another window, another user
    too_late = [(6, 3, at(10)), (7, 3, at(300))]
    got, _ = streamed([first, late, [(8, 4, at(200))], [(9, 4, at(200))], too_late], EVENTS, lambda s: timers.limited(s, 2, 10, "60 seconds"))
    assert {r["event_id"]: r["accepted"] for r in got} == {1: True, 2: True, 3: False, 4: True, 5: True, 7: True, 8: True, 9: True}


@pytest.mark.parametrize("seed", [2, 3])
def test_debounced_stream_equals_the_table_form(spark, streamed, seed):
    """Batches overlap in time: what is late within the delay counts as if it had come in order."""
    rows = events(seed, 90, spread=60)
    rng = random.Random(seed)
    mixed = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.uniform(0, 5)))
    got, ckpt = streamed([mixed[:30], mixed[30:60], mixed[60:], closing(rows[-1][2])], EVENTS, lambda s: timers.debounced(s, 900, "10 seconds"))
    want = limits.debounced(spark.createDataFrame(rows, EVENTS), 900)
    assert sorted((r["event_id"], r["user_id"], r["ts"]) for r in got if r["user_id"] != 99) == sorted((r["event_id"], r["user_id"], r["ts"]) for r in want.collect())
    left = spark.read.format("statestore").option("stateVarName", "held").load(ckpt).collect()
    assert {r["key"]["user_id"] for r in left} <= {99}


def test_a_session_forgets_when_idle(spark, streamed):
    at = lambda s: START + timedelta(seconds=s)
    row = lambda s, kind, word, session="a": (session, at(s), kind, "NON_WORD", word, None)
    ddl = "session string, ts timestamp, kind string, error_class string, original string, first string"
    batches = [
        [row(0, "edit", "x"), row(1, "ignore", "x"), row(2, "edit", "x"), row(2, "edit", "y"), row(3, "edit", "x", "b")],
        [row(10, "edit", "x"), row(10, "ignore", "y"), row(10, "edit", "y")],
        [row(500, "edit", "x")],  # idle for longer than 100 s
        [row(100_000, "edit", "z", "c")],
    ]
    got, ckpt = streamed(batches, ddl, lambda s: timers.without_ignored(s, 100, "0 seconds"))
    shown = sorted((r["session"], int((r["ts"] - START).total_seconds()), r["original"]) for r in got)
    assert shown == [("a", 0, "x"), ("a", 2, "y"), ("a", 500, "x"), ("b", 3, "x"), ("c", 100_000, "z")]
    left = spark.read.format("statestore").option("stateVarName", "last").load(ckpt).collect()
    assert {r["key"]["session"] for r in left} <= {"c"}


def test_times():
    assert timers.millis_after(1000) == 1 and timers.millis_after(1001) == 2
    assert list(timers.timestamps([1_000_000]))[0] == datetime(1970, 1, 1, 0, 0, 1)
