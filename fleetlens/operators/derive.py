"""Rates from cumulative counters: each row against the previous sample of its key, by lag over one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TICKS = 100  # jiffies in a second


def _since(column: str | Column, window, clamp: bool = True) -> Column:
    """Growth since the previous sample (null for the first); a counter that went back has grown by 0."""
    c = F.col(column) if isinstance(column, str) else column
    grown = c - F.lag(c).over(window)
    return F.when(grown < 0, F.lit(0)).otherwise(grown) if clamp else grown


def seconds_since(ts: str, window) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(F.col(ts)) - micros(F.lag(ts).over(window))) / F.lit(1_000_000.0)


def cpu_rates(df: DataFrame, keys: tuple[str, ...] = ("host",), order: tuple[str, ...] = ("timestamp", "seq")) -> DataFrame:
    """cpu_percent, cpu_user, cpu_system and cpu_iowait of c_* counters; 0.0 for a first sample or without progress.

    Waiting for input counts as busy.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    counters = [c for c in ("c_user", "c_nice", "c_system", "c_idle", "c_iowait", "c_irq", "c_softirq", "c_steal") if c in df.columns]
    grown = df.withColumns({f"d_{c[2:]}": _since(c, w) for c in counters})
    total = F.col(f"d_{counters[0][2:]}")
    for c in counters[1:]:
        total = total + F.col(f"d_{c[2:]}")
    grown = grown.withColumn("d_total", total)
    share = lambda x: F.coalesce(F.try_divide(F.lit(100.0) * x, F.col("d_total").cast("double")), F.lit(0.0))
    return grown.withColumns({"cpu_percent": share(F.col("d_total") - F.col("d_idle")), "cpu_user": share(F.col("d_user") + F.col("d_nice")), "cpu_system": share(F.col("d_system")), "cpu_iowait": share(F.col("d_iowait"))}).drop(*[f"d_{c[2:]}" for c in counters], "d_total")


def memory_use(df: DataFrame) -> DataFrame:
    """mem_used, mem_percent and swap_used of mem_total, mem_available, swap_total and swap_free."""
    zero = F.lit(0).cast("long")
    used = F.greatest(F.col("mem_total") - F.col("mem_available"), zero)
    return df.withColumns({"mem_used": used, "mem_percent": F.when(F.col("mem_total") > 0, F.lit(100.0) * used.cast("double") / F.col("mem_total")).otherwise(F.lit(0.0)), "swap_used": F.greatest(F.col("swap_total") - F.col("swap_free"), zero)})


def swap_percent(used: Column, total: Column) -> Column:
    return F.when(total > 0, F.lit(100.0) * used.cast("double") / total.cast("double")).otherwise(F.lit(0.0))


def process_rates(df: DataFrame, keys: tuple[str, ...] = ("host", "pid"), order: tuple[str, ...] = ("timestamp", "seq")) -> DataFrame:
    """cpu_percent of the jiffies column; 0.0 at first sight, without time between samples, or for a reused pid."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({"_d": _since("jiffies", w), "_s": seconds_since("timestamp", w)})
    return rows.withColumn("cpu_percent", F.when(F.col("_s") > 0, F.lit(100.0) * F.col("_d") / (F.lit(float(TICKS)) * F.col("_s"))).otherwise(F.lit(0.0))).drop("_d", "_s")


def container_rates(df: DataFrame, keys: tuple[str, ...] = ("host", "vmid"), order: tuple[str, ...] = ("timestamp", "seq")) -> DataFrame:
    """cpu_pct of usage_usec (400 is four cores); null, not 0, without an earlier sample or time between."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({"_d": _since("usage_usec", w), "_s": seconds_since("timestamp", w)})
    return rows.withColumn("cpu_pct", F.when(F.col("_s") > 0, F.col("_d") / (F.col("_s") * F.lit(1_000_000.0)) * F.lit(100.0))).drop("_d", "_s")


def self_rates(df: DataFrame, keys: tuple[str, ...] = ("host",), order: tuple[str, ...] = ("timestamp", "seq")) -> DataFrame:
    """The agent's own cpu_percent (0.0 at first) and uptime_seconds, whole seconds since its first sample."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({"_d": _since("jiffies", w), "_s": seconds_since("timestamp", w)})
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    up = F.floor((micros(F.col("timestamp")) - micros(F.min("timestamp").over(Window.partitionBy(*keys)))) / F.lit(1_000_000)).cast("long")
    return rows.withColumns({"cpu_percent": F.when(F.col("_s") > 0, F.col("_d") / F.lit(float(TICKS)) / F.col("_s") * F.lit(100.0)).otherwise(F.lit(0.0)), "uptime_seconds": up}).drop("_d", "_s")
