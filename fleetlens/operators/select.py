"""Snapshots, ranges, searches and top-k listings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions.scalars import parse_duration, parse_priority
from fleetlens.functions.timeutil import moment, time_filter

#: Total orders, as (column, whether descending): what is asked for first, then what makes equal processes comparable.
BY_CPU = (("cpu_percent", True), ("pid", False), ("mem_rss", False), ("name", False), ("cmdline", False), ("uid", False))
BY_MEM = (("mem_rss", True), ("cpu_percent", True), ("pid", False), ("name", False), ("cmdline", False), ("uid", False))
BY_NAME = (("name", False), ("cpu_percent", True), ("pid", False), ("mem_rss", False), ("cmdline", False), ("uid", False))


def ordering(names: tuple[tuple[str, bool], ...]) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in names]


def latest_row(df: DataFrame, *order: Column) -> DataFrame:
    """The newest row: a distributed top-1, not a sort."""
    return df.orderBy(*(order or (F.desc("timestamp"),))).limit(1)


def latest_by_host(df: DataFrame, *order: str) -> DataFrame:
    """The newest row of each host, by one map-side combined aggregate."""
    row = F.struct(*df.columns)
    return df.groupBy("host").agg(F.max_by(row, F.struct(*(order or ("timestamp",)))).alias("_r")).select("_r.*")


def snapshot_at(df: DataFrame, t: datetime | str) -> DataFrame:
    """All rows of one sample."""
    return time_filter(df, t, t)


def latest_snapshot(df: DataFrame, keys: tuple[str, ...] = ("host",), time: str = "timestamp") -> DataFrame:
    """All rows with the newest time of their host, so that a host that reported late or not at all lately is not lost.

    The newest times are one row for each key, by a map-side combined aggregate, and Spark broadcasts them if they are
    few; with a date column they prune the dates that are read. Without keys it is the newest time of the whole table.
    """
    dated = ["date"] if "date" in df.columns and time == "timestamp" else []
    if not keys:
        if dated:
            df = df.filter(F.col("date") == df.agg(F.max("date").alias("d")).scalar())
        return df.filter(F.col(time) == df.agg(F.max(time).alias("t")).scalar())
    newest = df.groupBy(*keys).agg(F.max(time).alias(time), *[F.max(c).alias(c) for c in dated])
    return df.join(newest, [*keys, time, *dated], "left_semi")


def metrics_period(df: DataFrame, now: datetime | str, period: str = "1h") -> DataFrame:
    """Rows from `now` minus a duration on, ascending."""
    since = datetime.fromisoformat(str(now)) - timedelta(seconds=parse_duration(period))
    return time_filter(df, since).orderBy(F.asc_nulls_last("timestamp"))


def search_logs(df: DataFrame, since: datetime | str | None = None, unit: str | None = None, priority: str | int | None = None) -> DataFrame:
    """Log rows, newest first; only the filters that are given are in the plan. Priority is matched exactly."""
    df = time_filter(df, since)
    if unit is not None:
        df = df.filter(F.col("unit") == unit)
    if priority is not None:
        df = df.filter(F.col("priority") == parse_priority(priority))
    return df.orderBy(F.desc("timestamp"), F.desc("seq"))


def name_contains(df: DataFrame, text: str) -> DataFrame:
    """Processes whose name or command line has the text in it: literal, case-sensitive."""
    return df.filter(F.col("name").contains(text) | F.col("cmdline").contains(text))


def ranked_per_host(df: DataFrame, *order: Column, keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """All rows of each host with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or ordering(BY_CPU)))))


def top_per_host(df: DataFrame, k: int, *order: Column, keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """The first k rows of each host with their rank from 1; Spark cuts to k before the shuffle."""
    return ranked_per_host(df, *order, keys=keys).filter(F.col("rank") <= k)


def newest_by_tier(logs: DataFrame, k: int = 20, keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """k log rows for each key: warnings and worse first, newest arrival first inside a tier."""
    tier = F.when(F.col("priority") <= 4, 0).otherwise(1)
    return top_per_host(logs, k, tier.asc(), F.desc("seq"), keys=keys)


__all__ = ["BY_CPU", "BY_MEM", "BY_NAME", "latest_by_host", "latest_row", "latest_snapshot", "metrics_period", "moment", "name_contains", "newest_by_tier", "ordering", "ranked_per_host", "search_logs", "snapshot_at", "top_per_host"]
