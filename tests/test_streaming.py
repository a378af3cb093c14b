"""Streams worked off with availableNow give what the batch operators give."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fleetlens.operators import derive
from fleetlens.operators.store import Store
from fleetlens.streaming import jobs


def test_journal_stream_fills_the_table(spark, tmp_path):
    (tmp_path / "in" / "host-1").mkdir(parents=True)
    (tmp_path / "in" / "host-1" / "a.json").write_text("\n".join(json.dumps({"MESSAGE": f"m{i}", "PRIORITY": "3", "__REALTIME_TIMESTAMP": str(1_700_000_000_000_000 + i)}) for i in range(5)) + "\n{bad\n")
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    for _ in range(2):  # a second run finds nothing new
        jobs.append(jobs.journal_stream(spark, str(tmp_path / "in")), store, "logs", str(tmp_path / "ck"), every=None).awaitTermination()
    rows = store.read("logs").collect()
    assert sorted(r["message"] for r in rows) == [f"m{i}" for i in range(5)] and {r["host"] for r in rows} == {"host-1"}


def test_lines_keep_their_order_and_batches_are_bounded(spark, tmp_path):
    (tmp_path / "in" / "h").mkdir(parents=True)
    for k in range(3):
        (tmp_path / "in" / "h" / f"{k}.log").write_text("".join(f"{k}-{i}\n" for i in range(20)))
        os.utime(tmp_path / "in" / "h" / f"{k}.log", (1_700_000_000 + k, 1_700_000_000 + k))
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    q = jobs.append(jobs.file_stream(spark, str(tmp_path / "in"), per_trigger=1), store, "logs", str(tmp_path / "ck"), every=None)
    q.awaitTermination()
    # one file in each batch: what exceeds the bound waits
    assert store.log("logs").snapshot().last(jobs.stream_id(spark, str(tmp_path / "ck" / "logs"))) == 2
    rows = store.read("logs").orderBy("seq").collect()
    assert [r["message"] for r in rows] == [f"{k}-{i}" for k in range(3) for i in range(20)] and len({r["seq"] for r in rows}) == 60


def test_one_stream_fails_alone(spark, tmp_path):
    (tmp_path / "in" / "h").mkdir(parents=True)
    (tmp_path / "in" / "h" / "x.log").write_text("one\ntwo\n")
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    good = jobs.file_stream(spark, str(tmp_path / "in"))
    bad = good.withColumn("mount_point", F.raise_error(F.lit("broken"))).withColumnRenamed("host", "host")
    running = jobs.append_all({"disks": bad, "logs": good}, store, str(tmp_path / "ck"), every=None)
    with pytest.raises(StreamingQueryException):
        running["disks"].awaitTermination()
    running["logs"].awaitTermination()
    assert store.read("logs").count() == 2 and store.read("disks").count() == 0


def test_file_stream(spark, tmp_path):
    (tmp_path / "in" / "h").mkdir(parents=True)
    (tmp_path / "in" / "h" / "x.log").write_text("one\ntwo\n")
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    jobs.append(jobs.file_stream(spark, str(tmp_path / "in")), store, "logs", str(tmp_path / "ck"), every=None).awaitTermination()
    assert sorted((r["message"], r["priority"], r["unit"]) for r in store.read("logs").collect()) == [("one", 6, None), ("two", 6, None)]


def test_keyed_state_equals_lag(spark, tmp_path):
    pytest.importorskip("google.protobuf", reason="stateful processing in Python needs it")
    schema = "host string, vmid int, timestamp timestamp_ntz, seq long, usage_usec long, mem_current long, mem_max long"
    rows = [("h", v, datetime(2024, 1, 1) + timedelta(seconds=10 * i), i * 10 + v, (i * 700_000 * v) % 3_000_000, i, None if v % 2 else 9) for i in range(12) for v in range(4)]
    df = spark.createDataFrame(rows, schema)
    for part in range(2):  # two files in order of time, so that state has to carry over batches
        df.filter(f"seq >= {part * 60} and seq < {part * 60 + 60}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.container_rates(stream, ttl_ms=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert q.awaitTermination(300)
    got = {(r["vmid"], r["seq"]): r["cpu_pct"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["vmid"], r["seq"]): r["cpu_pct"] for r in derive.container_rates(df).collect()}
    assert got == pytest.approx(want)
    assert sum(x is None for x in got.values()) == 4


def _worked_off(spark, tmp_path, rows, schema, stream, parts=3):
    """A stream over files that come one after the other, each run a new start from the checkpoint; rows by seq."""
    pytest.importorskip("google.protobuf", reason="stateful processing in Python needs it")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    times = sorted({r[1] for r in rows})
    try:
        for k in range(parts):
            cut = times[len(times) * k // parts : len(times) * (k + 1) // parts]
            spark.createDataFrame([r for r in rows if r[1] in cut], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            frame = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            q = stream(frame).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            assert q.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return {r["seq"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_host_and_self_rates_equal_lag(spark, tmp_path):
    schema = "host string, timestamp timestamp_ntz, seq long, c_user long, c_nice long, c_system long, c_idle long, c_iowait long, jiffies long"
    rows = [(f"h{h}", datetime(2024, 1, 1) + timedelta(seconds=10 * (i // 2)), 100 * h + i, (i * 37 * (h + 1)) % 500, i // 5, i * 3, i * 50, i % 4, (i * i * 7) % 900) for h in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, schema)
    for name, stream, batch, columns in (("host", jobs.host_rates, derive.cpu_rates, ("cpu_percent", "cpu_user", "cpu_system", "cpu_iowait")), ("self", jobs.self_rates, derive.self_rates, ("cpu_percent", "uptime_seconds"))):
        got = _worked_off(spark, tmp_path / name, rows, schema, lambda f, s=stream: s(f, ttl_ms=None))
        want = {r["seq"]: r for r in batch(df).collect()}
        assert len(got) == len(want) == 60
        for k, r in want.items():
            assert [got[k][c] for c in columns] == pytest.approx([r[c] for c in columns]), (name, k)


def test_process_rates_equal_lag_and_forget_the_dead(spark, tmp_path):
    schema = "host string, timestamp timestamp_ntz, seq long, pid int, started long, jiffies long"
    rows, seq = [], 0
    for i in range(15):
        for h in range(2):
            for pid in range(1, 6):
                if pid == 2 and i > 4 or pid == 3 and 4 < i < 12:  # one ends, one is away for longer than samples are kept
                    continue
                started = 1 if pid == 4 and i >= 7 else 0  # a pid that is used again, with a higher counter
                rows.append((f"h{h}", datetime(2024, 1, 1) + timedelta(seconds=10 * i), seq, pid, started, 1000 * started + (i * pid * 13) % 300))
                seq += 1
    got = _worked_off(spark, tmp_path, rows, schema, lambda f: jobs.process_rates(f, keep_s=60, ttl_ms=None))
    df = spark.createDataFrame(rows, schema)
    want = {r["seq"]: r["cpu_percent"] for r in derive.process_rates(df, keys=("host", "pid", "started")).collect()}
    assert len(got) == len(want) == len(rows)
    back = {r[2] for r in rows if r[3] == 3 and r[1] == datetime(2024, 1, 1) + timedelta(seconds=120)}
    assert len(back) == 2
    for k, x in want.items():
        assert got[k]["cpu_percent"] == pytest.approx(0.0 if k in back else x), k
    again = [r[2] for r in rows if r[3] == 4 and r[1] == datetime(2024, 1, 1) + timedelta(seconds=70)]
    assert all(got[k]["cpu_percent"] == 0.0 for k in again)


def test_state_of_containers_lies_in_buckets_not_one_by_one(spark, tmp_path):
    schema = "host string, timestamp timestamp_ntz, vmid int, seq long, usage_usec long, mem_current long, mem_max long"
    rows = [("h", datetime(2024, 1, 1) + timedelta(seconds=10 * i), v, i * 100 + v, i * 700 * v, i, None) for i in range(2) for v in range(100)]
    got = _worked_off(spark, tmp_path, rows, schema, lambda f: jobs.container_rates(f, ttl_ms=None), parts=1)
    assert len(got) == 200 and sum(r["cpu_pct"] is None for r in got.values()) == 100
    kept = spark.read.format("statestore").option("stateVarName", "samples").load(str(tmp_path / "ck"))
    assert 1 < kept.count() <= jobs.BUCKETS
