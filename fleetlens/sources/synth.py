"""Synthetic fleets for load tests: samples of a list of hosts, derived by expressions, at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The generated fleet's first moment, its step and its figures.
START = "2026-04-25 00:00:00"
STEP_SECONDS = 10
#: Generated rows of a task, about.
TASK_ROWS = 500_000


def samples(hosts: DataFrame, count: int, per_sample: int = 1) -> DataFrame:
    """(host, sample, timestamp): `count` samples for each host, ten seconds apart; `per_sample` is how many rows one becomes.

    A list of hosts is a small file, which Spark reads in one task. So the hosts, and parts of the samples of each where
    there are many, are dealt out over as many tasks as the rows to be generated need, and the samples made there.
    """
    each = max(1, min(count, TASK_ROWS // per_sample))
    parts = hosts.select("host", F.explode(F.sequence(F.lit(0), F.lit(count - 1), F.lit(each))).alias("_from"))
    tasks = -(-hosts.count() * count * per_sample // TASK_ROWS)
    last = F.least(F.col("_from") + each, F.lit(count)) - 1
    sample = parts.repartition(max(1, tasks)).select("host", F.explode(F.sequence("_from", last)).alias("sample"))
    return sample.withColumn("timestamp", F.expr(f"cast(timestamp_seconds(unix_timestamp(timestamp'{START}') + sample * {STEP_SECONDS}) AS timestamp_ntz)"))


def metrics(hosts: DataFrame, count: int = 60_480) -> DataFrame:
    i = F.col("sample").cast("long")
    return samples(hosts, count).select("host", "timestamp", (F.lit(20.0).cast("double") + i % 10).alias("cpu_percent"), F.lit(10.0).alias("cpu_user"), F.lit(5.0).alias("cpu_system"), F.lit(0.5).alias("cpu_iowait"), F.lit(16_000_000_000).alias("mem_total"), (F.lit(1_500_000_000) + i % 100_000_000).alias("mem_used"), F.lit(10.0).alias("mem_percent"), F.lit(0).cast("long").alias("swap_total"), F.lit(0).cast("long").alias("swap_used"))


def _process(p: int) -> str:
    """What is the same in all samples of a process, as constants of SQL."""
    user = "root" if p % 5 == 0 else "user"
    return f"named_struct('pid', {p + 100}L, 'name', 'process-{p % 50}', 'command', '/usr/bin/process-{p % 50} --flag=', 'cpu_percent', {p % 100}.0D, 'mem_rss', {p * 1000 + 100_000_000}L, 'threads', {p % 8 + 4}L, 'username', '{user}')"


def processes(hosts: DataFrame, count: int = 60_480, per_sample: int = 200) -> DataFrame:
    """per_sample processes in each sample; the processes are a fixed small list, made once and exploded in place."""
    made = F.expr(f"inline(array({', '.join(map(_process, range(per_sample)))}))")
    rows = samples(hosts, count, per_sample).select("host", "timestamp", F.col("sample").cast("string").alias("flag"), made)
    return rows.select("host", "timestamp", "pid", "name", F.concat("command", "flag").alias("cmdline"), F.lit("S").alias("state"), "cpu_percent", "mem_rss", "threads", "username")


def disks(hosts: DataFrame, count: int = 60_480, per_sample: int = 5) -> DataFrame:
    i = F.col("sample").cast("long")
    rows = samples(hosts, count, per_sample).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(per_sample - 1))))
    return rows.select("host", "timestamp", F.concat(F.lit("/mount-"), F.col("d").cast("string")).alias("mount_point"), F.lit("ext4").alias("filesystem"), F.lit(100_000_000_000).alias("total_bytes"), (F.lit(50_000_000_000) + i * 1000).alias("used_bytes"), (F.lit(50.0).cast("double") + i % 30).alias("percent"))
