"""The commit log: batches are there once, whatever is run again, cut off or run beside, and readers see whole commits."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import commits
from fleetlens.operators.commits import Conflict, ReplacedWriter
from fleetlens.operators.store import Store, bins
from fleetlens.streaming import jobs

DAY = datetime(2024, 1, 1)
COLUMNS = "host string, timestamp timestamp_ntz, cpu_percent float"
STEPS = ["before data", "after data", "before commit", "after commit"]


class Cut(RuntimeError):
    pass


def cut_at(step, times=1):
    """A step function that ends the run when it comes to `step`."""
    left = [times]

    def at(name):
        if name == step and left[0]:
            left[0] -= 1
            raise Cut(name)

    return at


def rows(spark, *values):
    return spark.createDataFrame([("h", DAY + timedelta(hours=h), float(v)) for h, v in values], COLUMNS)


def values(store, **options):
    return sorted(r["cpu_percent"] for r in store.read("metrics", **options).collect())


def store_of(spark, path, **options):
    store = Store(spark, str(path), **options)
    store.create()
    return store


def test_a_batch_is_there_once(spark, tmp_path):
    store = store_of(spark, tmp_path)
    assert store.append("metrics", rows(spark, (0, 1)), "s", 0) and not store.append("metrics", rows(spark, (0, 9)), "s", 0)
    assert store.append("metrics", rows(spark, (0, 2)), "s", 1) and store.append("metrics", rows(spark, (0, 3)), "other", 0)
    store.append("metrics", rows(spark, (0, 4)))
    store.append("metrics", rows(spark, (0, 4)))
    assert values(store) == [1, 2, 3, 4, 4]


@pytest.mark.parametrize("step", STEPS)
def test_an_append_that_was_cut_off(spark, tmp_path, step):
    store_of(spark, tmp_path).append("metrics", rows(spark, (0, 1)), "s", 0)
    with pytest.raises(Cut):
        Store(spark, str(tmp_path), cut_at(step)).append("metrics", rows(spark, (1, 2), (30, 3)), "s", 1)
    store = Store(spark, str(tmp_path))
    assert values(store) == ([1, 2, 3] if step == "after commit" else [1])
    store.append("metrics", rows(spark, (1, 2), (30, 3)), "s", 1)
    assert values(store) == [1, 2, 3]


@pytest.mark.parametrize("step", STEPS)
def test_a_retention_that_was_cut_off(spark, tmp_path, step):
    store = store_of(spark, tmp_path)
    for n, (h, v) in enumerate([(0, 1), (25, 2), (40, 3), (50, 4)]):
        store.append("metrics", rows(spark, (h, v)), "s", n)
    with pytest.raises(Cut):
        Store(spark, str(tmp_path), cut_at(step)).retain(DAY + timedelta(hours=54), timedelta(hours=24))
    assert values(store) in ([1, 2, 3, 4], [3, 4])
    store.retain(DAY + timedelta(hours=54), timedelta(hours=24))
    assert values(store) == [3, 4]
    for n, (h, v) in enumerate([(0, 1), (25, 2), (40, 3), (50, 4)]):  # the whole stream is run again
        assert not store.append("metrics", rows(spark, (h, v)), "s", n)
    assert values(store) == [3, 4]


def test_retention_beside_appends(spark, tmp_path):
    """An append to the boundary date that comes between retention's look and its commit is neither lost nor doubled."""
    store = store_of(spark, tmp_path)
    store.append("metrics", rows(spark, (25, 1), (40, 2)), "s", 0)
    came = []

    def step(name):
        if name == "after data" and not came:
            came.append(store.append("metrics", rows(spark, (41, 3)), "s", 1))

    Store(spark, str(tmp_path), step).retain(DAY + timedelta(hours=54), timedelta(hours=24))
    assert came == [True] and values(store) == [2, 3]


def test_compaction_and_retention_meet(spark, tmp_path):
    store = store_of(spark, tmp_path)
    for n in range(4):
        store.append("metrics", rows(spark, (25 + n, n)), "s", n)
    retained = []

    def step(name):
        if name == "after data" and not retained:
            retained.append(True)
            store.retain(DAY + timedelta(hours=51), timedelta(hours=24))

    assert Store(spark, str(tmp_path), step).compact("metrics") == 0  # retention replaced its files
    assert values(store) == [2, 3]
    compacted = []

    def other(name):
        if name == "after data" and not compacted:
            compacted.append(store.compact("metrics"))

    store.append("metrics", rows(spark, (29, 9)), "s", 4)
    Store(spark, str(tmp_path), other).retain(DAY + timedelta(hours=52), timedelta(hours=24))  # begins again
    assert compacted[0] >= 2 and values(store) == [3, 9]


def test_compaction(spark, tmp_path):
    store = store_of(spark, tmp_path)
    for n in range(23):  # past one list of all files
        store.append("metrics", rows(spark, (n, n), (n + 24, 100 + n)), "s", n)
    want = values(store)
    before, version = store.read("metrics"), store.log("metrics").snapshot().version
    assert len(store.log("metrics").live(store.log("metrics").snapshot())) >= 46
    assert store.compact("metrics") >= 46 and len(store.log("metrics").live(store.log("metrics").snapshot())) == 2
    assert values(store) == want == sorted(r["cpu_percent"] for r in before.collect()) == values(store, version=version)
    assert store.compact("metrics") == 0 and not store.append("metrics", rows(spark, (0, 7)), "s", 22)
    # replaced files go once nobody can be reading them
    store.vacuum(datetime(2000, 1, 1))
    assert before.count() == len(want)
    store.vacuum(datetime(2100, 1, 1))
    assert values(store) == want and len(list((tmp_path / "metrics" / "data").glob("*/*/*.parquet"))) == 2
    assert min(store.log("metrics").versions()) > commits.EVERY
    store.append("metrics", rows(spark, (1, 50)), "s", 23)
    assert values(store) == sorted([*want, 50])


@pytest.mark.parametrize("step", [*STEPS, "before list"])
def test_a_compaction_that_was_cut_off(spark, tmp_path, step):
    store = store_of(spark, tmp_path)
    for n in range(commits.EVERY - 2):
        store.append("metrics", rows(spark, (n % 3, n)), "s", n)
    with pytest.raises(Cut):
        Store(spark, str(tmp_path), cut_at(step)).compact("metrics")
    assert values(store) == list(range(commits.EVERY - 2))
    store.compact("metrics")
    store.append("metrics", rows(spark, (0, 99)), "s", 99)
    assert values(store) == [*range(commits.EVERY - 2), 99]
    store.vacuum(datetime(2100, 1, 1))
    assert values(store) == [*range(commits.EVERY - 2), 99]


def test_two_writers_take_one_number_each(spark, tmp_path):
    store, came = store_of(spark, tmp_path), []

    def step(name):
        if name == "before commit" and not came:
            came.append(store.append("metrics", rows(spark, (1, 2)), "b", 0))

    assert Store(spark, str(tmp_path), step).append("metrics", rows(spark, (0, 1)), "a", 0)
    assert values(store) == [1, 2] and store.log("metrics").versions() == [1, 2, 3]


def test_a_second_run_of_a_stream_replaces_the_first(spark, tmp_path):
    store = store_of(spark, tmp_path)
    first, second = store.log("metrics").begin("s"), store.log("metrics").begin("s")
    assert second == first + 1 and store.append("metrics", rows(spark, (0, 1)), "s", 0, second)
    with pytest.raises(ReplacedWriter):
        store.append("metrics", rows(spark, (0, 2)), "s", 1, first)
    assert values(store) == [1]


def test_files_that_are_gone_are_not_replaced(spark, tmp_path):
    log = store_of(spark, tmp_path).log("metrics")
    with pytest.raises(Conflict):
        log.commit("compact", [], [("commit=x/date=2024-01-01/a.parquet", "2024-01-01", 1)])


def test_a_row_without_host_or_time_is_an_error(spark, tmp_path):
    store = store_of(spark, tmp_path)
    for bad in ((None, DAY, 1.0), ("h", None, 1.0)):
        with pytest.raises(Exception, match="without host or time"):
            store.append("metrics", spark.createDataFrame([("h", DAY, 1.0), bad], COLUMNS), "s", 0)
    assert values(store) == []


def test_bins():
    files = [(f"f{i}", "2024-01-0" + str(1 + i % 2), size) for i, size in enumerate([60, 50, 40, 50, 10, 200, 5, 1])]
    got = bins(files, 100)
    assert sorted(sorted(f[0] for f in b) for b in got) == [["f0", "f2"], ["f1", "f3"], ["f4", "f6"]] or all(sum(f[2] for f in b) <= 100 and len({f[1] for f in b}) == 1 and len(b) > 1 for b in got)
    assert not any(f[0] == "f5" for b in got for f in b)


def test_only_files_of_the_dates_are_opened(spark, tmp_path):
    store = store_of(spark, tmp_path)
    for n in range(6):
        store.append("metrics", rows(spark, (24 * n, n)))
    got = store.read("metrics", since=DAY + timedelta(days=2), until=DAY + timedelta(days=3))
    assert len(got.inputFiles()) == 2 and sorted(r["cpu_percent"] for r in got.collect()) == [2, 3]


def test_searches_skip_row_groups(spark, tmp_path):
    """After compaction a unit's rows lie together, and files tell by bloom filters that they have none of it."""
    spark.conf.set("parquet.block.size", "65536")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "65536")
    try:
        store = store_of(spark, tmp_path)
        for n in range(3):
            data = spark.range(20_000).select(F.lit("h").alias("host"), F.lit(str(DAY)).cast("timestamp_ntz").alias("timestamp"), F.col("id").alias("seq"), F.concat(F.lit("unit-"), F.pmod(F.xxhash64("id"), F.lit(500)).cast("string")).alias("unit"), F.sha2(F.col("id").cast("string"), 256).alias("message"))
            store.append("logs", data, "s", n)

        def scanned():
            df = store.read("logs").filter("unit = 'unit-77'").select("unit", "message")
            n = len(df.collect())
            plan = df._jdf.queryExecution().executedPlan()
            leaves = plan.collectLeaves()
            return n, leaves.head().metrics().apply("numOutputRows").value()

        n, before = scanned()
        store.compact("logs")
        again, after = scanned()
        assert n == again > 0 and after < before / 10
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")


def test_streams_share_a_table_and_survive_a_lost_checkpoint(spark, tmp_path):
    (tmp_path / "in" / "h").mkdir(parents=True)
    (tmp_path / "in" / "h" / "x.log").write_text("one\n")
    store = store_of(spark, tmp_path / "store")
    for checkpoint in ("a", "b", "a", "c"):  # c: as if a had been lost
        jobs.append(jobs.file_stream(spark, str(tmp_path / "in")), store, "logs", str(tmp_path / checkpoint), every=None).awaitTermination()
    assert [r["message"] for r in store.read("logs").collect()] == ["one"] * 3


def test_dead_letters(spark, tmp_path):
    schema = spark.createDataFrame([], "host string, metrics struct<timestamp timestamp_ntz, cpu_percent double>, processes array<struct<pid int, name string>>, disks array<struct<mount_point string>>, logs array<struct<timestamp timestamp_ntz, seq bigint, message string>>, containers array<struct<vmid int>>, container_metrics array<struct<vmid int>>").schema
    good = '{"host":"%s","metrics":{"timestamp":"2024-01-01T00:00:00.000000","cpu_percent":1.5},"processes":[{"pid":1,"name":"a"}],"logs":[{"message":"m"}]}'
    bad = {"not json": "not JSON", "": "empty", "[1]": "not an object", "3": "not an object", '{"host":"b"}': "no time", '{"metrics":{"timestamp":"2024-01-01T00:00:00.000000"}}': "no host", good.replace('"pid":1', '"pid":"x"') % "c": "a value of another type"}
    (tmp_path / "in" / "box").mkdir(parents=True)
    (tmp_path / "in" / "box" / "a.json").write_text("\n".join([good % "h1", *bad, good % "h2"]) + "\n")
    store = store_of(spark, tmp_path / "store")

    def run():
        for q in jobs.append_all(jobs.document_streams(spark, str(tmp_path / "in"), schema), store, str(tmp_path / "ck"), every=None).values():
            q.awaitTermination()

    run()
    run()
    assert sorted(r["host"] for r in store.read("metrics").collect()) == ["h1", "h2"] and store.read("logs").filter("timestamp IS NULL OR host IS NULL").count() == 0
    dead = store.read("dead_letters").collect()
    assert {r["document"]: r["reason"] for r in dead} == bad and all(r["host"] == "box" and r["path"].endswith("a.json") for r in dead)
    assert len(dead) + store.read("metrics").count() == 9
    # repaired ones go on, once, also when the replay is cut off on its way
    repair = lambda d: d.withColumn("document", F.regexp_replace("document", '"pid":"x"', '"pid":7'))
    for step in ("after data", "before commit"):
        version = store.log("dead_letters").snapshot().version
        with pytest.raises(Cut):
            jobs.replay(Store(spark, store.root, cut_at(step)), schema, repair, version)
    assert jobs.replay(store, schema, repair, version) == version
    assert sorted(r["host"] for r in store.read("metrics").collect()) == ["c", "h1", "h2"] and sorted(r["pid"] for r in store.read("processes").collect()) == [1, 1, 7]
    assert store.read("dead_letters").count() == 6


def test_an_append_reads_each_commit_once(spark, tmp_path, monkeypatch):
    store, read = Store(spark, str(tmp_path)), []
    store.create()
    rows = spark.createDataFrame([("h", datetime(2024, 1, 1))], "host string, timestamp timestamp_ntz")
    for k in range(3):
        store.append("logs", rows, "s", k)
    plain = commits.Files.read
    monkeypatch.setattr(commits.Files, "read", lambda self, path: read.append(path) or plain(self, path))
    store.append("logs", rows, "s", 3)
    assert len(read) == len(set(read)) == 4
    assert store.read("logs").count() == 4
