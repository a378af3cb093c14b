"""Joins of telemetry: user names, running guests with their counters, and mounts deduplicated by device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.sources.captures import real_filesystem

#: Account tables up to this many rows (about 100 bytes each) are broadcast.
BROADCAST_ROWS = 100_000


def with_usernames(processes: DataFrame, accounts: DataFrame, on: tuple[str, ...] = ("host", "uid")) -> DataFrame:
    """username of each process's uid on its host, the uid itself as text where no account there has it."""
    small = accounts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return processes.join(F.broadcast(accounts) if small else accounts, list(on), "left").withColumn("username", F.coalesce("username", F.col("uid").cast("string")))


def guest_metrics(guests: DataFrame, counters: DataFrame, on: tuple[str, ...] = ("host", "timestamp", "vmid")) -> DataFrame:
    """Running guests with their control-group counters of the same host and moment; guests without counters have no row, mem_max may be null."""
    return guests.filter(F.col("status") == "running").join(counters, list(on))


def distinct_disks(mounts: DataFrame, keys: tuple[str, ...] = ("host", "timestamp", "device")) -> DataFrame:
    """One mount for each device of a host at a moment: the shortest path (first listed on a tie), with the first listed mount's capacity."""
    real = mounts.filter(real_filesystem(F.col("fstype")))
    shortest = Window.partitionBy(*keys).orderBy(F.length("mount_point"), "line_no")
    listed = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capacity = {c: F.first(c).over(listed) for c in ("f_blocks", "f_bfree", "f_frsize")}
    return real.withColumns({"_n": F.row_number().over(shortest), **capacity}).filter("_n = 1").drop("_n")
