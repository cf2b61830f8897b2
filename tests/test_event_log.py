"""The event log as a stream: nothing lost, nothing twice, over restarts; admission, slices, trimming."""

from datetime import datetime, timedelta

import pytest
from scriptorium.sources import event_log
from scriptorium.sources.event_log import Log

T0 = datetime(2024, 1, 1)
DDL = "event_id long, user_id string, ts timestamp"


def events(spark, first, n, parts=2):
    return spark.createDataFrame([(i, f"u{i % 3}", T0 + timedelta(seconds=i)) for i in range(first, first + n)], DDL).repartition(parts)


@pytest.fixture
def log(spark, tmp_path):
    event_log.register(spark)
    path = str(tmp_path / "log")
    event_log.append(events(spark, 0, 50), path)
    event_log.append(events(spark, 50, 30, 1), path)
    return path


def run(spark, path, out, most=17, consumer="c", until=None):
    """Batches until all that is there has been read; the rows of each batch, also of those from before."""
    sizes = []

    def write(df, batch):
        if until is not None and batch >= until:
            raise RuntimeError("stopped on purpose")
        df.write.mode("overwrite").parquet(f"{out}/batch-{batch:04}")
        sizes.append(df.count())

    stream = spark.readStream.format("event_log").option("path", path).option("max_rows", most).option("slice", 10).option("consumer", consumer).load()
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/ckpt").start()
    try:
        q.processAllAvailable()
    except Exception:
        assert until is not None
    finally:
        q.stop()
    return sizes


def seen(spark, out):
    return sorted(r["event_id"] for r in spark.read.parquet(f"{out}/batch-*").collect())


def test_batches_are_bounded_and_whole(spark, log, tmp_path):
    out = str(tmp_path / "out")
    sizes = run(spark, log, out)
    assert seen(spark, out) == list(range(80)) and max(sizes) <= 17 and sum(sizes) == 80


def test_a_restart_loses_and_repeats_nothing(spark, log, tmp_path):
    out = str(tmp_path / "out")
    run(spark, log, out, until=2)  # fails within its third batch
    assert len(seen(spark, out)) < 80
    event_log.append(events(spark, 80, 25), log)  # meanwhile
    run(spark, log, out)
    assert seen(spark, out) == list(range(105))
    assert run(spark, log, out) == []
    event_log.append(events(spark, 105, 5), log)
    assert sum(run(spark, log, out)) == 5 and seen(spark, out) == list(range(110))


def test_trimming_waits_for_every_consumer(spark, log, tmp_path):
    assert event_log.trimmed(spark, log) == []
    run(spark, log, str(tmp_path / "a"), consumer="a")
    Log(log).commit("b", {"file": "", "row": 0})
    assert event_log.trimmed(spark, log) == []
    run(spark, log, str(tmp_path / "b"), consumer="b")
    gone = event_log.trimmed(spark, log)
    assert gone == ["segment-000000000000"] and Log(log).segments() == ["segment-000000000001"]
    event_log.append(events(spark, 80, 4), log)
    assert sum(run(spark, log, str(tmp_path / "a"), consumer="a")) == 4
    assert seen(spark, str(tmp_path / "a")) == list(range(84))


def test_segments_that_are_not_whole_do_not_count(spark, log, tmp_path):
    events(spark, 900, 5).write.parquet(f"{log}/_making-x/segment-000000000002")
    assert Log(log).segments() == ["segment-000000000000", "segment-000000000001"]
    assert sum(run(spark, log, str(tmp_path / "out"))) == 80


def test_offsets():
    class Fake(Log):
        def __init__(self):
            self.sizes = {"segment-0/a": 3, "segment-0/b": 0, "segment-1/a": 5}

        def files(self, since=""):
            return [f for f in self.sizes if f >= since]

        def rows(self, file):
            return self.sizes[file]

    log, start = Fake(), {"file": "", "row": 0}
    assert log.after(start, 2) == {"file": "segment-0/a", "row": 2}
    assert log.after(log.after(start, 2), 2) == {"file": "segment-1/a", "row": 1}
    assert log.after(start, 100) == {"file": "segment-1/a", "row": 5}
    assert log.after(log.after(start, 100), 100) == {"file": "segment-1/a", "row": 5}
