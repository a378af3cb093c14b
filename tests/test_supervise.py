"""Streams that fail are counted and started again with growing pauses, and leave the others alone."""

import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.store import Store
from fleetlens.streaming import jobs
from fleetlens.streaming.supervise import Supervisor


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    made.create()
    (tmp_path / "in" / "h").mkdir(parents=True)
    (tmp_path / "in" / "h" / "x.log").write_text("one\ntwo\n")
    return made


def test_a_failing_stream_is_started_again(spark, store, tmp_path):
    broken = tmp_path / "broken"
    broken.write_text("")

    def rows():
        good = jobs.file_stream(spark, str(tmp_path / "in"))
        return good.withColumn("priority", F.raise_error(F.lit("no room")).cast("int")) if broken.exists() else good

    watch = Supervisor(spark, first=0.1)
    try:
        watch.add_all({"logs": lambda: jobs.append(rows(), store, "logs", str(tmp_path / "a"), every="0 seconds"), "other": lambda: jobs.append(jobs.file_stream(spark, str(tmp_path / "in")), store, "logs", str(tmp_path / "b"), every="0 seconds")})
        end = time.monotonic() + 60
        while watch.streams["logs"].failures < 3 and time.monotonic() < end:
            watch.run(0.3)
        got = {r["stream"]: r for r in watch.figures().collect()}
        assert got["logs"]["failures"] >= 3 and got["logs"]["consecutive_failures"] >= 3 and "no room" in got["logs"]["last_error"]
        assert got["other"]["failures"] == 0 and got["other"]["starts"] == 1
        agent = spark.createDataFrame([("h", 0)], "host string, consecutive_insert_failures int")
        assert watch.in_agent_block(agent).first()["consecutive_insert_failures"] >= 3
        broken.unlink()
        while watch.consecutive_insert_failures() and time.monotonic() < end:
            watch.run(0.3)
        assert watch.consecutive_insert_failures() == 0 and watch.streams["logs"].failures >= 3
        for w in watch.streams.values():
            w.query.processAllAvailable()
    finally:
        watch.stop()
    # each stream's rows once, whatever was tried in between
    assert sorted(r["message"] for r in store.read("logs").collect()) == ["one", "one", "two", "two"]


def test_pauses_grow_to_a_bound(spark):
    now = [0.0]
    watch = Supervisor(spark, first=1, longest=6, clock=lambda: now[0])

    def start():
        raise RuntimeError("no source")

    try:
        watch.add("s", start)
        pauses = []
        for _ in range(5):
            pauses.append(watch.streams["s"].due - now[0])
            now[0] = watch.streams["s"].due - 0.01
            watch.tick()
            now[0] += 0.01
            starts = watch.streams["s"].starts
            watch.tick()
            assert watch.streams["s"].starts == starts + 1
        assert pauses == pytest.approx([1, 2, 4, 6, 6]) and watch.consecutive_insert_failures() == 6
    finally:
        watch.stop()


def test_a_stream_that_ends_is_done(spark, store, tmp_path):
    watch = Supervisor(spark)
    try:
        watch.add("logs", lambda: jobs.append(jobs.file_stream(spark, str(tmp_path / "in")), store, "logs", str(tmp_path / "a"), every=None))
        watch.run(60)
        assert watch.streams["logs"].done and watch.streams["logs"].failures == 0
    finally:
        watch.stop()
    assert store.read("logs").count() == 2


def test_retention_and_compaction_beside_a_stream(spark, store, tmp_path):
    """Old rows go while new ones come; a chore that fails is tried again and stops nothing."""
    from datetime import datetime, timedelta

    store.append("logs", spark.createDataFrame([("h", datetime(2020, 1, 1), 1, "old")], "host string, timestamp timestamp_ntz, seq long, message string"))
    watch, broken = Supervisor(spark, first=0.1), [True]

    def retain():
        if broken.pop() if broken else False:
            raise RuntimeError("not now")
        store.retain(datetime.now(), timedelta(days=7))

    try:
        watch.add("logs", lambda: jobs.append(jobs.file_stream(spark, str(tmp_path / "in")), store, "logs", str(tmp_path / "a"), every="0 seconds"))
        watch.schedule("retention", 1, retain)
        watch.schedule("compaction", 1, lambda: store.compact("logs"))
        for k in range(3):
            (tmp_path / "in" / "h" / f"{k}.log").write_text(f"more {k}\n")
            watch.run(4)
        watch.streams["logs"].query.processAllAvailable()
        store.retain(datetime.now(), timedelta(days=7))
        assert watch.chores["retention"].runs >= 2 and watch.chores["retention"].failures == 1 and watch.chores["retention"].last_error == "not now"
        assert watch.chores["compaction"].failures == 0 and watch.streams["logs"].failures == 0
    finally:
        watch.stop()
    assert sorted(r["message"] for r in store.read("logs").collect()) == ["more 0", "more 1", "more 2", "one", "two"]
