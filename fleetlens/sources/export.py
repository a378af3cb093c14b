"""JSON and CSV export: text columns, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import csv_cell


#: What each listing writes, in order, and which of its numbers have two decimals.
METRICS = ("cpu_percent", "cpu_user", "cpu_system", "cpu_iowait", "mem_total", "mem_used", "mem_percent", "swap_total", "swap_used")
PROCESSES = ("pid", "name", "cmdline", "state", "cpu_percent", "mem_rss", "threads", "username")
DISKS = ("mount_point", "filesystem", "total_bytes", "used_bytes", "percent")
TOP = ("pid", "name", "cpu_percent", "mem_rss", "threads", "username")
DECIMALS = ("cpu_percent", "cpu_user", "cpu_system", "cpu_iowait", "mem_percent", "percent")


def two_decimals(x: Column) -> Column:
    """A share in percent as it is written: two decimals, halves up; null is 0, as in all typed listings."""
    return F.floor(F.coalesce(x.cast("double"), F.lit(0.0)) * 100 + 0.5).cast("decimal(18,0)").cast("decimal(18,2)") * F.lit("0.01").cast("decimal(3,2)")


def _field(of: Column | None, c: str) -> Column:
    value = F.col(c) if of is None else of[c]
    return (two_decimals(value).cast("decimal(18,2)") if c in DECIMALS else value).alias(c)


def fields(columns: tuple[str, ...], of: Column | None = None) -> list[Column]:
    """The columns of a listing, of a frame or of a struct, as they are written."""
    return [_field(of, c) for c in columns]


def status_lines(status: DataFrame) -> DataFrame:
    """host and its whole status document as JSON text: metrics, disks and busiest processes, and when it was made and sampled."""
    disks = F.transform(F.coalesce("disks", F.array()), lambda x: F.struct(*fields(DISKS, x)))
    top = F.transform(F.coalesce("top", F.array()), lambda x: F.struct(*fields(TOP, x)))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return status.select("host", F.to_json(F.struct(F.col("host").alias("hostname"), seconds("now").alias("timestamp"), seconds("timestamp").alias("sampled"), *fields(METRICS), disks.alias("disks"), top.alias("top_processes")), {"ignoreNullFields": "false"}).alias("line"))


def as_text(df: DataFrame) -> DataFrame:
    """Every cell as text, null kept: the shape of an ad-hoc query's result."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def json_line(columns: list[str], optional: tuple[str, ...] = ()) -> Column:
    """A JSON object of the columns; null stays as null but for the optional ones, whose key goes."""
    always = F.to_json(F.struct(*[c for c in columns if c not in optional]), {"ignoreNullFields": "false"})
    if not optional:
        return always
    extra = F.to_json(F.struct(*optional))
    return F.when(extra == "{}", always).otherwise(F.concat(F.substring(always, F.lit(1), F.length(always) - 1), F.lit(","), F.substring(extra, F.lit(2), F.length(extra))))


def csv_line(columns: list[str]) -> Column:
    return F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns])


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')
