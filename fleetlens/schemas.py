"""Schemas of the six telemetry tables and of raw captures; host, date and seq are this engine's own additions."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    common = [T.StructField("host", T.StringType(), False), T.StructField("timestamp", T.TimestampNTZType(), False)]
    return T.StructType(common + [T.StructField(n, t) for n, t in fields] + [T.StructField("date", T.DateType())])


I, L, F, D, S = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType()

TABLES: dict[str, T.StructType] = {
    "metrics": _table(("cpu_percent", F), ("cpu_user", F), ("cpu_system", F), ("cpu_iowait", F), ("mem_percent", F), ("mem_total", L), ("mem_used", L), ("swap_total", L), ("swap_used", L)),
    "processes": _table(("pid", I), ("name", S), ("cmdline", S), ("state", S), ("cpu_percent", F), ("mem_rss", L), ("threads", I), ("username", S)),
    "disks": _table(("mount_point", S), ("filesystem", S), ("total_bytes", L), ("used_bytes", L), ("percent", F)),
    "logs": _table(("seq", L), ("source", S), ("unit", S), ("identifier", S), ("systemd_unit", S), ("priority", I), ("message", S), ("pid", I)),
    "containers": _table(("vmid", I), ("name", S), ("node", S), ("type", S), ("status", S), ("maxmem", L), ("maxcpu", D), ("uptime", L)),
    "container_metrics": _table(("vmid", I), ("cpu_pct", D), ("mem_current", L), ("mem_max", L)),
}

#: Documents that could not be taken apart, with the reason and where they stood; `timestamp` is when they were met.
SCHEMAS: dict[str, T.StructType] = TABLES | {"dead_letters": _table(("path", S), ("seq", L), ("reason", S), ("document", S))}

#: A text snapshot of one file that a host's collector reads.
RAW_CAPTURE = T.StructType([T.StructField("host", S), T.StructField("timestamp", T.TimestampNTZType()), T.StructField("path", S), T.StructField("content", S)])
