"""Generated fleets are dealt out over tasks."""

from fleetlens.sources import synth


def test_hosts_of_one_file_are_generated_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(synth, "TASK_ROWS", 60)
    spark.range(9).selectExpr("'h' || id AS host").coalesce(1).write.parquet(str(tmp_path / "hosts"))
    got = synth.processes(spark.read.parquet(str(tmp_path / "hosts")), 7, 20)
    sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == got.distinct().count() == 9 * 7 * 20 and len(sizes) == 21 and max(sizes) <= 180
    assert synth.metrics(spark.createDataFrame([], "host string"), 5).count() == 0
