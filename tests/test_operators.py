"""The reference's tested contracts, and the cases it leaves untested, on small frames."""

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetlens.functions import scalars
from fleetlens.functions.timeutil import time_filter
from fleetlens.operators import benchstats, derive, joins, payload
from fleetlens.operators import select as sel
from fleetlens.operators.store import Store
from fleetlens.plans import sqlapi
from fleetlens.schemas import TABLES
from fleetlens.sources import captures, inventory, logs

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(spark, column, texts, kind="string"):
    return [r[0] for r in frame(spark, [(i, t) for i, t in enumerate(texts)], f"i int, x {kind}").orderBy("i").select(column(F.col("x"))).collect()]


def test_durations(spark):
    texts = ["30s", "30m", "1h", "1d", "1w", "-2h", "s", "5", "5y", "", None, "1.5h"]
    assert values(spark, scalars.duration_seconds, texts) == [30, 1800, 3600, 86400, 604800, -7200] + [None] * 6
    assert scalars.parse_duration("1d") == 86400
    with pytest.raises(ValueError):
        scalars.parse_duration("5y")


def test_priorities(spark):
    assert values(spark, scalars.priority_number, ["emerg", "err", "error", "warn", "debug", "5", "255", "256", "x", None]) == [0, 3, 3, 4, 7, 5, 255, None, None, None]
    assert values(spark, scalars.priority_label, [0, 3, 7, 8, -1, None], "int") == ["EMERG", "ERROR", "DEBUG", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    with pytest.raises(ValueError):
        scalars.parse_priority("loud")


def test_bytes_bar_and_truncation(spark):
    assert values(spark, scalars.human_bytes, [0, 1023, 1024, 1536, 1024**2, 3 * 1024**4], "long") == ["0B", "1023B", "1.0KB", "1.5KB", "1.0MB", "3.0TB"]
    assert values(spark, lambda c: scalars.progress_bar(c, 4), [0.0, 50.0, 99.9, 250.0, -3.0], "double") == ["----", "##--", "###-", "####", "----"]
    assert values(spark, lambda c: scalars.truncated(c, 4), ["abcde", "abéé", "\U0001f600\U0001f600", "a\U0001f600", "", None]) == ["abcd", "abé", "\U0001f600", "a", "", None]


def test_cpu_capture_and_rates(spark):
    rows = [("a", at(0), "cpu  10 0 10 80 0 0 0\ncpu0 1"), ("a", at(10), "cpu  20 0 20 150 10 0 0 0"), ("a", at(20), "cpu  20 0 20 150 10 0 0 0"), ("a", at(30), "cpu  5 0 5 10 0 0 0 0"), ("b", at(0), "intr 5"), ("b", at(1), "cpu x y")]
    got = derive.cpu_rates(captures.cpu_counters(frame(spark, rows, "host string, timestamp timestamp_ntz, content string")), order=("timestamp",)).orderBy("timestamp").collect()
    assert [r["cpu_percent"] for r in got] == [0.0, 30.0, 0.0, 0.0]
    assert (got[1]["cpu_user"], got[1]["cpu_system"], got[1]["cpu_iowait"]) == (10.0, 10.0, 10.0)
    assert got[0]["c_steal"] == 0 and got[0]["c_total"] == 100


def test_first_samples_and_resets(spark):
    rows = [("a", 1, at(0), 0, 100), ("a", 1, at(10), 1, 600), ("a", 1, at(20), 2, 50), ("a", 1, at(20), 3, 90)]
    df = frame(spark, rows, "host string, vmid int, timestamp timestamp_ntz, seq long, usage_usec long")
    assert [r["cpu_pct"] for r in derive.container_rates(df).orderBy("seq").collect()] == [None, 0.005, 0.0, None]
    jiffies = df.withColumnsRenamed({"vmid": "pid", "usage_usec": "jiffies"})
    assert [r["cpu_percent"] for r in derive.process_rates(jiffies).orderBy("seq").collect()] == [0.0, 50.0, 0.0, 0.0]
    assert [(r["cpu_percent"], r["uptime_seconds"]) for r in derive.self_rates(jiffies).orderBy("seq").collect()] == [(0.0, 0), (50.0, 10), (0.0, 20), (0.0, 20)]


def test_memory(spark):
    df = frame(spark, [(100, 30, 0, 0), (0, 5, 10, 4), (10, 20, 5, 9)], "mem_total long, mem_available long, swap_total long, swap_free long")
    assert [(r["mem_used"], r["mem_percent"], r["swap_used"]) for r in derive.memory_use(df).collect()] == [(70, 70.0, 0), (0, 0.0, 6), (0, 0.0, 0)]


def test_pid_stat_uid_cmdline(spark):
    stat = "12 (a (b) c) S " + " ".join(map(str, range(1, 40)))
    df = frame(spark, [("h", at(0), stat), ("h", at(0), "12 (x"), ("h", at(0), "")], "host string, timestamp timestamp_ntz, content string")
    r = captures.pid_stat(df).collect()
    assert len(r) == 1 and (r[0]["name"], r[0]["state"], r[0]["utime"], r[0]["stime"], r[0]["threads"], r[0]["mem_rss"]) == ("a (b) c", "S", 11, 12, 17, 21 * 4096)
    assert values(spark, captures.uid, ["Name:\tx\nUid:\t1000\t0", "nothing", None]) == [1000, 0, None]
    assert values(spark, captures.cmdline, ["a\0b\0\0", "", None]) == ["a b", "", ""]


def test_passwd_and_usernames(spark):
    acc = captures.passwd(frame(spark, [("h", "root:x:0:0::/:/bin/sh\nbad\nsecond:x:0:1\nx::7:z")], "host string, content string"))
    assert sorted((r["uid"], r["username"]) for r in acc.filter("uid = 0").collect()) == [(0, "root")]
    got = joins.with_usernames(frame(spark, [("h", 0), ("h", 5)], "host string, uid long"), acc).collect()
    assert sorted((r["uid"], r["username"]) for r in got) == [(0, "root"), (5, "5")]


def test_mounts(spark):
    text = "/dev/a /mnt/long ext4 rw\n\nshort\n/dev/a /m ext4\n/dev/a /n ext4\ntmpfs /t tmpfs\n/dev/b /o overlay\ncg /c cgroup2"
    m = captures.mounts(frame(spark, [("h", at(0), text)], "host string, timestamp timestamp_ntz, content string"))
    m = m.withColumns({"f_blocks": F.col("line_no").cast("long") + 10, "f_bfree": F.lit(20).cast("long"), "f_frsize": F.lit(2).cast("long")})
    got = captures.disk_usage(joins.distinct_disks(m, ("host", "timestamp", "device"))).orderBy("device").collect()
    assert [(r["device"], r["mount_point"], r["f_blocks"], r["used_bytes"]) for r in got] == [("/dev/a", "/m", 10, 0), ("/dev/b", "/o", 16, 0)]


def test_cgroups(spark):
    texts = ["0::/lxc/101/ns", "5:cpu:/lxc.payload.7/x", "0::/my-lxc/42/", "0::/user.slice", "", None]
    assert values(spark, captures.cgroup_vmid, texts) == [101, 7, None, None, None, None]
    keys = "host string, timestamp timestamp_ntz, vmid int, content string"
    cpu = frame(spark, [("h", at(0), v, t) for v, t in ((1, "usage_usec 5\nuser_usec 1"), (2, ""), (3, "usage_usec 7"), (4, "usage_usec 9"))], keys)
    cur = frame(spark, [("h", at(0), v, t) for v, t in ((1, "100\n"), (2, "1"), (3, None), (4, "8"))], keys)
    most = frame(spark, [("h", at(0), 1, "max\n")], keys)
    assert sorted((r["vmid"], r["usage_usec"], r["mem_current"], r["mem_max"]) for r in captures.cgroup_counters(cpu, cur, most).collect()) == [(1, 5, 100, None), (4, 9, 8, None)]


def test_runtime(spark):
    df = frame(spark, [("0::/lxc/5", True), ("0::/", True), ("0::/", False), (None, None)], "cg string, dir boolean")
    got = df.select(captures.runtime(F.col("cg"), F.col("dir"), F.lit(" "), F.lit("8.1 \nx")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("container", None, None, 5), ("host", "unknown", "8.1", None), ("none", None, None, None), ("none", None, None, None)]


def test_journal(spark):
    lines = [
        '{"__REALTIME_TIMESTAMP":"1700000000999999","SYSLOG_IDENTIFIER":"sshd","_SYSTEMD_UNIT":"ssh.service","PRIORITY":"4","MESSAGE":"hi","_PID":"7"}',
        '{"_SYSTEMD_UNIT":"x.service","PRIORITY":"bad","_PID":"z"}',
        "{broken",
        '["a"]',
        '{"MESSAGE":[104,105]}',
        '{"__REALTIME_TIMESTAMP":"-1"}',
        "",
        '{"PRIORITY":"300","_PID":"-5"}',
        '{"PRIORITY":"255","_PID":"4294967296"}',
    ]
    df = frame(spark, [("h", i, t) for i, t in enumerate(lines)], "host string, seq long, value string")
    got = logs.journal(df, F.lit("2024-01-01 00:00:00")).orderBy("seq").collect()
    assert [r["seq"] for r in got] == [0, 1, 5, 7, 8] and [(r["priority"], r["pid"]) for r in got[3:]] == [(6, None), (255, None)]
    assert tuple(got[0])[0] == datetime(2023, 11, 14, 22, 13, 20) and got[0]["unit"] == "sshd" and got[0]["pid"] == 7
    assert (got[1]["unit"], got[1]["priority"], got[1]["message"], got[1]["pid"], got[1]["timestamp"]) == ("x.service", 6, "", None, T0)
    assert got[2]["timestamp"] == datetime(1969, 12, 31, 23, 59, 59)
    assert sorted(r["seq"] for r in logs.quarantined(df).collect()) == [2, 3, 4, 6]


def test_inventory(spark):
    docs = [
        '[{"vmid":100,"node":"n","type":"lxc","name":"a","status":"running","maxmem":5,"maxcpu":2,"uptime":9},{"vmid":101.9,"node":"n","type":"qemu","maxmem":-1},{"vmid":1,"node":"n","type":"storage"}]',
        '[{"vmid":"7","node":"n","type":"lxc"},{"vmid":4294967296,"node":"n","type":"lxc"},{"vmid":-1,"node":"n","type":"lxc"},{"node":"n","type":"lxc"},{"vmid":null,"node":"n","type":"lxc"},{"vmid":5,"type":"lxc"},3,null]',
        '{"vmid":1,"node":"n","type":"lxc"}',
        "[{",
        "[]",
        '[{"vmid":8,"node":"n","type":"lxc","name":"' + "x" * 600 + '"}]',
    ]
    df = frame(spark, [(i, t) for i, t in enumerate(docs)], "i int, content string")
    got = inventory.guests(df).orderBy("i", "vmid").collect()
    assert [(r["vmid"], r["name"][:3], r["status"], r["maxmem"], r["uptime"]) for r in got] == [(100, "a", "running", 5, 9), (101, "qem", "unknown", 0, 0), (8, "xxx", "unknown", 0, 0)]
    assert len(got[2]["name"]) == 256
    assert sorted(r["i"] for r in inventory.broken(df).collect()) == [2, 3]


PROC = "host string, timestamp timestamp_ntz, pid int, name string, cmdline string, cpu_percent double, mem_rss long, threads int, uid long"


def test_processes(spark):
    df = frame(spark, [("h", at(0), i, f"p{i}", f"/bin/p{i} %_", float(i), 100 - i, 1, 0) for i in range(1, 31)], PROC)
    top = payload.top_processes(df).orderBy("rank").collect()
    assert [r["pid"] for r in top] == list(range(30, 5, -1)) and "cmdline" not in top[0]
    assert [r["pid"] for r in sel.top_per_host(df, 2, *sel.ordering(sel.BY_MEM)).orderBy("rank").collect()] == [1, 2]
    assert sel.name_contains(df, "%_").count() == 30 and sel.name_contains(df, "P1").count() == 0 and sel.name_contains(df, "").count() == 30


LOG = "host string, timestamp timestamp_ntz, seq long, unit string, priority int, message string, pid int"


def batched(df):
    return df.withColumn("batch", F.date_trunc("day", "timestamp").cast("timestamp_ntz"))


def test_log_selection(spark):
    df = frame(spark, [("h", at(i), i, "u", 4, "é" * 2500, None) for i in range(101)], LOG)
    df = batched(df)
    got = payload.selected_logs(df).orderBy("rank").collect()
    assert [r["seq"] for r in got] == list(range(100, 80, -1)) and {len(r["message"].encode()) for r in got} == {4096}
    assert [tuple(r) for r in payload.log_stats(df).collect()] == [("h", T0, 101, 20, 81)]
    # a batch is selected and counted by itself
    two = batched(frame(spark, [("h", at(i % 2 * 86400), i, "u", 4, "m", None) for i in range(50)], LOG))
    assert sorted((r["batch"].day, r["seen"], r["uploaded"]) for r in payload.log_stats(two).collect()) == [(1, 25, 20), (2, 25, 20)]
    assert payload.selected_logs(two).count() == 40
    mixed = frame(spark, [("h", at(0), 0, "u", 3, "a", None), ("h", at(0), 1, "u", 6, "b", None), ("h", at(0), 2, "u", 4, "c", None)], LOG)
    assert [r["seq"] for r in payload.selected_logs(batched(mixed)).orderBy("rank").collect()] == [2, 0, 1]


def test_log_search(spark):
    df = frame(spark, [("h", at(i), i, "u" if i % 2 else None, i % 8, "m", None) for i in range(40)], LOG)
    assert sel.search_logs(df).count() == 40
    got = [r["seq"] for r in sel.search_logs(df, since=at(10), unit="u", priority="err").collect()]
    assert got == [35, 27, 19, 11]


def test_payload_round_trip(spark):
    m = frame(spark, [("h", at(0), 1.0), ("lonely", at(0), None)], "host string, timestamp timestamp_ntz, cpu_percent double")
    p = frame(spark, [("h", at(0), 1, "n", "c", 5.0, 1, 1, 0)], PROC)
    d = frame(spark, [("h", "/", 5.0)], "host string, mount_point string, percent double")
    lg = batched(frame(spark, [("h", at(0), 1, "u", 4, 'say "x"\n', None), ("h", at(-90000), 0, "u", 1, "an older batch", None)], LOG))
    c = frame(spark, [("h", 5, "n")], "host string, vmid int, name string")
    cm = frame(spark, [("h", 5, None, None)], "host string, vmid int, cpu_pct double, mem_max long")
    doc = payload.nested(m, p, d, lg, c, cm)
    texts = {r["host"]: r["document"] for r in payload.to_document(doc).collect()}
    assert '"cpu_pct":null' in texts["h"] and '"mem_max":null' in texts["h"] and '"processes":[]' in texts["lonely"]
    back = payload.from_document(payload.to_document(doc), doc.schema, "logs").collect()
    assert [(r["host"], r["message"]) for r in back] == [("h", 'say "x"\n')]
    flat = payload.flattened(payload.to_document(doc), doc.schema)
    assert set(flat) == {"metrics", *payload.PARTS} and [r["pid"] for r in flat["processes"].collect()] == [1]
    assert sorted((r["host"], r["cpu_percent"]) for r in flat["metrics"].collect()) == [("h", 1.0), ("lonely", None)]
    runtime = frame(spark, [("h", "container", None, None, 5)], "host string, kind string, node string, version string, vmid int")
    agent = frame(spark, [("h", 1.5, 100)], "host string, cpu_percent double, rss_kb long")
    texts = {r["host"]: r["document"] for r in payload.to_document(payload.nested(m, p, d, lg, c, cm, runtime, agent)).collect()}
    assert '"runtime":{"kind":"container","node":null,"version":null,"vmid":5}' in texts["h"] and '"agent":{"cpu_percent":1.5,"rss_kb":100}' in texts["h"]
    assert '"runtime":null' in texts["lonely"]


def test_snapshots_by_host(spark):
    df = frame(spark, [("a", at(10), 1), ("a", at(0), 2), ("b", at(9), 3), ("b", at(9), 4)], "host string, timestamp timestamp_ntz, pid int")
    assert sorted(r["pid"] for r in sel.latest_snapshot(df).collect()) == [1, 3, 4]
    assert [r["pid"] for r in sel.latest_snapshot(df, keys=()).collect()] == [1]
    dated = df.withColumn("date", F.to_date("timestamp"))
    assert sorted(r["pid"] for r in sel.latest_snapshot(dated).collect()) == [1, 3, 4]


def test_hosts_do_not_mix(spark):
    m = frame(spark, [(h, at(0), "/dev/sda1", p, "ext4", n, 5, 1, 1) for h, p, n in (("a", "/long", 0), ("a", "/s", 1), ("b", "/other", 0))], "host string, timestamp timestamp_ntz, device string, mount_point string, fstype string, line_no int, f_blocks long, f_bfree long, f_frsize long")
    assert sorted((r["host"], r["mount_point"]) for r in joins.distinct_disks(m).collect()) == [("a", "/s"), ("b", "/other")]
    acc = frame(spark, [("a", 0, "root"), ("b", 0, "toor")], "host string, uid long, username string")
    p = frame(spark, [("a", 0), ("b", 0), ("c", 0)], "host string, uid long")
    assert sorted((r["host"], r["username"]) for r in joins.with_usernames(p, acc).collect()) == [("a", "root"), ("b", "toor"), ("c", "0")]
    g = frame(spark, [("a", at(0), 5, "running"), ("b", at(0), 5, "running"), ("b", at(9), 5, "stopped")], "host string, timestamp timestamp_ntz, vmid int, status string")
    c = frame(spark, [("a", at(0), 5, 1), ("b", at(0), 5, 2), ("b", at(9), 5, 3)], "host string, timestamp timestamp_ntz, vmid int, usage_usec long")
    assert sorted((r["host"], r["usage_usec"]) for r in joins.guest_metrics(g, c).collect()) == [("a", 1), ("b", 2)]


def test_exports(spark, tmp_path):
    from fleetlens.sources import export

    df = frame(spark, [(1, 'say "x"', None), (2, "a,b\nc", 5)], "i int, t string, n int")
    export.write_json(df, str(tmp_path / "j"))
    assert sorted((r["i"], r["t"], r["n"]) for r in spark.read.schema(df.schema).json(str(tmp_path / "j")).collect()) == [(1, 'say "x"', None), (2, "a,b\nc", 5)]
    export.write_csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"', multiLine=True, schema=df.schema)
    assert sorted((r["i"], r["t"], r["n"]) for r in back.collect()) == [(1, 'say "x"', None), (2, "a,b\nc", 5)]
    assert export.as_text(df).dtypes == [("i", "string"), ("t", "string"), ("n", "string")]


def test_bench(spark):
    df = frame(spark, [("a", float(x), 1024 * x) for x in (4, 1, 3, 2)] + [("b", 1.0, 1), ("b", 1.0, 1)], "label string, cpu double, rss_kb long")
    got = {r["label"]: r for r in benchstats.stats(df).collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["p50"], got["a"]["p99"], got["a"]["rss_mb"]) == (4, 2.5, 3.0, 4.0, 4.0)
    assert [(r["delta_pct"], r["verdict"]) for r in benchstats.delta(benchstats.stats(df), "a", "b").collect()] == [(60.0, "reduction")]
    assert benchstats.delta(benchstats.stats(df), "none", "b").count() == 0
    gate = frame(spark, [("x", 51200, 2.0), ("y", 51201, 0.0), ("z", 1, 2.1)], "host string, rss_kb long, cpu double")
    assert {r["host"]: r["verdict"] for r in benchstats.gate(gate).collect()} == {"x": "PASS", "y": "FAIL", "z": "FAIL"}


def test_bench_sample_file(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1.5 100\n\nbad\n2.0 200\n")
    assert sorted(tuple(r) for r in benchstats.read_samples(spark, str(tmp_path)).collect()) == [(1.5, 100), (2.0, 200)]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create()
    rows = frame(spark, [("h", at(0), 1.0), ("h", at(86400 * 2 + 5), 2.0), ("h", at(86400 * 2 + 50), 3.0), ("h", at(86400 * 4), 4.0)], "host string, timestamp timestamp_ntz, cpu_percent float")
    store.append("metrics", rows)
    assert store.read("metrics").count() == 4 and store.read("logs").count() == 0
    plan = time_filter(store.read("metrics"), at(86400), at(86400 * 3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert sel.latest_snapshot(store.read("metrics")).first()["cpu_percent"] == 4.0
    store.retain(at(86400 * 4 + 10), timedelta(days=2))
    assert sorted(r["cpu_percent"] for r in store.read("metrics").collect()) == [3.0, 4.0]
    # nothing of the boundary date is left: its folder goes
    store.retain(at(86400 * 4 + 100), timedelta(days=2))
    assert [r["cpu_percent"] for r in store.read("metrics").collect()] == [4.0]


def test_all_six_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create()
    for name, schema in TABLES.items():
        row = {f.name: {"string": "x", "int": 1, "bigint": 2, "float": 0.5, "double": 0.25, "timestamp_ntz": at(5), "date": at(5).date()}[f.dataType.simpleString()] for f in schema}
        store.append(name, spark.createDataFrame([row], schema).drop("date"))
        assert [r.asDict() for r in store.read(name).collect()] == [row]


def test_views_of_the_session_come_back(spark):
    frame(spark, [(7,)], "a int").createOrReplaceTempView("fx_kept")
    assert sqlapi.query(spark, "SELECT a FROM fx_kept", {"fx_kept": frame(spark, [(1,)], "a int")}).collect() == [Row(a=1)]
    assert spark.table("fx_kept").collect() == [Row(a=7)]
    sqlapi.query(spark, "SELECT a FROM fx_gone", {"fx_gone": frame(spark, [(1,)], "a int")})
    assert not spark.catalog.tableExists("fx_gone")


def test_hostnames(spark):
    assert values(spark, captures.hostname, [" pve1 \n", "", None, " \n", "x" * 300, "é" * 200]) == ["pve1", "unknown", "unknown", "unknown", "x" * 256, "é" * 128]
    assert values(spark, captures.first_line, ["8.1 \nmore", "y" * 300]) == ["8.1", "y" * 256]


def test_added_columns(spark, tmp_path):
    """Files from before two log columns were added read as null there."""
    store = Store(spark, str(tmp_path))
    old = frame(spark, [("h", at(0), "s", "u", 4, "m")], "host string, timestamp timestamp_ntz, source string, unit string, priority int, message string")
    log = store.log("logs")
    log.commit("append", log.write(old.withColumn("date", F.col("timestamp").cast("date"))))
    store.append("logs", old.withColumn("identifier", F.lit("i")))
    assert sorted((r["identifier"] or "") for r in store.read("logs").collect()) == ["", "i"]


def test_read_only_sql(spark, tmp_path):
    views = {"fx_one": frame(spark, [(1,)], "a int")}
    frame(spark, [(9,)], "a int").createOrReplaceTempView("hidden")
    frame(spark, [(9,)], "a int").write.parquet(str(tmp_path / "p"))
    for good, want in (
        ("WITH x AS (SELECT a FROM fx_one) SELECT a FROM x ORDER BY a -- end", [Row(a=1)]),
        ("SELECT a FROM FX_ONE WHERE a IN (SELECT max(a) FROM fx_one) HAVING true", None),
        ("SELECT (SELECT max(a) FROM fx_one) AS a", [Row(a=1)]),
        ("SELECT f.a FROM fx_one f JOIN fx_one g ON f.a = g.a UNION SELECT a FROM fx_one", [Row(a=1)]),
        ("SELECT sum(id) AS a FROM range(3)", [Row(a=3)]),
        ("SELECT col AS a FROM fx_one LATERAL VIEW explode(array(a)) t AS col", [Row(a=1)]),
        ("SELECT a, row_number() OVER w AS r FROM (SELECT DISTINCT a FROM fx_one) WINDOW w AS (ORDER BY a) ORDER BY a LIMIT 5", [Row(a=1, r=1)]),
        ("SELECT a FROM fx_one INTERSECT SELECT * FROM VALUES (1), (2) t(a) EXCEPT SELECT 3", [Row(a=1)]),
        ("SELECT x.a FROM fx_one x, LATERAL (SELECT max(a) AS m FROM fx_one y WHERE y.a = x.a) WHERE m = 1 GROUP BY x.a HAVING count(*) > 0", [Row(a=1)]),
        ("SELECT /*+ BROADCAST(f) */ f.a FROM fx_one TABLESAMPLE (100 PERCENT) f WHERE EXISTS (SELECT 1 FROM fx_one) OFFSET 0", [Row(a=1)]),
        ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT max(n) AS a FROM r", [Row(a=3)]),
        ("SHOW TABLES", [Row(table_name="fx_one")]),
    ):
        if want is not None:
            assert sqlapi.query(spark, good, views).collect() == want, good
    assert sqlapi.query(spark, "DESCRIBE fx_one", views).first()["col_name"] == "a"
    assert sqlapi.query(spark, "DESCRIBE QUERY SELECT a AS b FROM fx_one", views).first()["col_name"] == "b"
    assert "Physical Plan" in sqlapi.query(spark, "EXPLAIN SELECT a FROM fx_one", views).first()[0]
    path = tmp_path / "p"
    for bad in (
        "DROP VIEW fx_one",
        "INSERT INTO fx_one VALUES (2)",
        "CREATE TABLE t AS SELECT 1",
        "SELECT 1) x; DROP VIEW fx_one --",
        "SELECT 1; SELECT 2",
        "SET a = b",
        f"SELECT * FROM parquet.`{path}`",
        f"SELECT a FROM fx_one WHERE a IN (SELECT a FROM parquet.`{path}`)",
        f"WITH x AS (SELECT * FROM parquet.`{path}`) SELECT * FROM x",
        f"SELECT (SELECT max(a) FROM parquet.`{path}`)",
        f"EXPLAIN SELECT * FROM parquet.`{path}`",
        "SELECT * FROM hidden",
        "SELECT * FROM spark_catalog.default.hidden",
        "DESCRIBE hidden",
        "EXPLAIN DROP VIEW fx_one",
        "SELECT reflect('java.lang.System', 'lineSeparator') FROM fx_one",
        "SELECT max(length(java_method('java.lang.System', 'lineSeparator'))) FROM fx_one",
        "CACHE TABLE fx_one",
        "ADD FILE '/etc/hosts'",
        f"FROM fx_one INSERT OVERWRITE DIRECTORY '{tmp_path / 'out'}' USING parquet SELECT a",
        "SELECT * FROM read_files('/tmp')",
    ):
        with pytest.raises(AnalysisException):
            sqlapi.query(spark, bad, views)
    spark.catalog.dropTempView("hidden")

