"""Time helpers: range filters that also prune date partitions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(t: datetime | str) -> Column:
    return F.lit(str(t)).cast("timestamp_ntz")


def time_filter(df: DataFrame, since: datetime | str | None = None, until: datetime | str | None = None) -> DataFrame:
    """Rows with since <= timestamp <= until; where df has a date column the implied dates are filtered too.

    Spark prunes partitions by the partition column alone, so the bound on timestamp is repeated as one on date.
    """
    dated = "date" in df.columns
    if since is not None:
        df = df.filter(F.col("timestamp") >= moment(since))
        df = df.filter(F.col("date") >= F.lit(str(since)[:10]).cast("date")) if dated else df
    if until is not None:
        df = df.filter(F.col("timestamp") <= moment(until))
        df = df.filter(F.col("date") <= F.lit(str(until)[:10]).cast("date")) if dated else df
    return df
