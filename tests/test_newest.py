"""The table of newest snapshots: equal to a scan of everything that came, whatever the order, and read without history."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import select as sel
from fleetlens.operators.newest import Newest
from fleetlens.streaming import jobs

SCHEMA = "host string, timestamp timestamp_ntz, pid int"
DAY = datetime(2024, 1, 1)


def history(seed, hosts=9, ticks=12):
    rng = random.Random(seed)
    return [(f"h{h}", DAY + timedelta(seconds=10 * t), 100 * t + k) for h in range(hosts) for t in range(ticks) if rng.random() < 0.7 for k in range(rng.randint(1, 3))]


def listed(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_scan_in_any_order(spark, tmp_path, seed):
    rows = history(seed)
    schema = spark.createDataFrame([], SCHEMA).schema
    kept = Newest(spark, str(tmp_path), schema, 4)
    batches = [[r for r in rows if (r[1] - DAY).seconds // 10 % 4 == k] for k in range(4)]
    random.Random(seed).shuffle(batches)
    seen = []
    for n, batch in enumerate(batches):
        seen += batch
        assert kept.update(spark.createDataFrame(batch, SCHEMA), "s", n)
        assert listed(kept.read()) == listed(sel.latest_snapshot(spark.createDataFrame(seen, SCHEMA)))
    assert not kept.update(spark.createDataFrame(batches[0], SCHEMA), "s", 0)
    # what is late changes nothing, another stream's rows of the same moment stand beside
    late = [("h0", DAY - timedelta(days=1), 1)]
    before = listed(kept.read())
    kept.update(spark.createDataFrame(late, SCHEMA))
    assert listed(kept.read()) == before
    last = max(r for r in before if r[0] == "h0")
    kept.update(spark.createDataFrame([(*last[:2], 7)], SCHEMA), "other", 0)
    assert listed(kept.read()) == sorted([*before, (*last[:2], 7)])


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    kept = Newest(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, 8)
    kept.update(spark.createDataFrame([(f"h{i}", DAY, i) for i in range(60)], SCHEMA))
    before = {p for p, _, _ in kept.log().live(kept.log().snapshot())}
    kept.update(spark.createDataFrame([("h3", DAY + timedelta(seconds=10), 1)], SCHEMA))
    after = {p for p, _, _ in kept.log().live(kept.log().snapshot())}
    assert len(before - after) == len(after - before) == 1 and kept.read().count() == 60


def test_two_streams_meet_in_one_bucket(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    kept, came = Newest(spark, str(tmp_path), schema, 1), []

    class Beside(Newest):
        def log(self):
            log = super().log()

            def step(name):
                if name == "after data" and not came:
                    came.append(kept.update(spark.createDataFrame([("b", DAY, 2)], SCHEMA), "b", 0))

            log.step = step
            return log

    kept.update(spark.createDataFrame([("c", DAY, 3)], SCHEMA), "c", 0)
    Beside(spark, str(tmp_path), schema, 1).update(spark.createDataFrame([("a", DAY, 1)], SCHEMA), "a", 0)
    assert listed(kept.read()) == [("a", DAY, 1), ("b", DAY, 2), ("c", DAY, 3)]


def test_stream_keeps_it_and_reads_no_history(spark, tmp_path):
    rows, schema = history(3), spark.createDataFrame([], SCHEMA).schema
    kept = Newest(spark, str(tmp_path / "newest"), schema, 4)
    for k in range(3):
        spark.createDataFrame([r for r in rows if (r[1] - DAY).seconds // 10 % 3 == k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.keep_newest(stream, kept, str(tmp_path / "ck"), every=None).awaitTermination()
    got = kept.read()
    assert listed(got) == listed(sel.latest_snapshot(spark.createDataFrame(rows, SCHEMA)))
    assert got.inputFiles() and all("/newest/data/commit=" in f for f in got.inputFiles())
    assert len(got.inputFiles()) == len(kept.log().live(kept.log().snapshot())) < len(list((tmp_path / "newest" / "data").glob("*/*/*.parquet")))


def test_a_batch_that_is_there_already_is_not_read(spark, tmp_path):
    kept = Newest(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema, 4)
    assert kept.update(spark.createDataFrame([("a", DAY, 1)], SCHEMA), "s", 0)
    broken = spark.createDataFrame([("a", DAY, 1)], SCHEMA).withColumn("host", F.raise_error(F.lit("was read")).cast("string"))
    assert not kept.update(broken, "s", 0)
    assert len(list((tmp_path / "data").iterdir())) == 1  # what was written aside is gone
