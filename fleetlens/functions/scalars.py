"""Scalar functions as Column expressions; all built-in, none of them a Python UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a duration's unit, priorities by name, labels by priority, steps of a byte size.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
PRIORITIES = {"emerg": 0, "alert": 1, "crit": 2, "err": 3, "error": 3, "warn": 4, "warning": 4, "notice": 5, "info": 6, "debug": 7}
LABELS = ("EMERG", "ALERT", "CRIT", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG")
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


def duration_seconds(text: Column) -> Column:
    """Seconds of '<integer><s|m|h|d|w>'; null for anything else."""
    number = F.regexp_extract(text, r"^([+-]?\d+)[smhdw]$", 1).try_cast("long")
    unit = F.right(text, F.lit(1))
    step = F.coalesce(*[F.when(unit == u, F.lit(s)) for u, s in UNIT_SECONDS.items()])
    return F.try_multiply(number, step.cast("long"))


def parse_duration(text: str) -> int:
    """The argument form: raises ValueError where the column form gives null."""
    m = re.fullmatch(r"([+-]?\d+)([smhdw])", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * UNIT_SECONDS[m[2]]


def priority_number(text: Column) -> Column:
    """0 to 7 for a name, 0 to 255 for a number, else null."""
    names = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])
    number = F.when(text.rlike(r"^\d{1,3}$"), text.try_cast("int"))
    return F.coalesce(F.try_element_at(names, text), F.when(number.between(0, 255), number))


def parse_priority(text: str | int) -> int:
    """The argument form: an unknown name is an error instead of a filter that is silently dropped."""
    found = PRIORITIES.get(str(text), int(text) if str(text).isdecimal() and int(text) <= 255 else None)
    if found is None:
        raise ValueError(f"not a priority: {text!r}")
    return found


def priority_label(priority: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, LABELS)), priority), F.lit("UNKNOWN"))


def byte_unit(size: Column) -> Column:
    out = F.lit("B")
    for k, unit in enumerate(BYTE_UNITS[1:], 1):
        out = F.when(size >= 1024**k, F.lit(unit)).otherwise(out)
    return out


def byte_value(size: Column) -> Column:
    """The number that stands before the unit, unrounded."""
    out = size.cast("double")
    for k in range(1, len(BYTE_UNITS)):
        out = F.when(size >= 1024**k, size.cast("double") / float(1024**k)).otherwise(out)
    return out


def human_bytes(size: Column) -> Column:
    """'512B', '1.5GB': steps of 1024, one decimal from KB on."""
    return F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit("B"))).otherwise(F.concat(F.format_string("%.1f", byte_value(size)), byte_unit(size)))


def progress_bar(percent: Column, width: int) -> Column:
    """width characters, '#' for the filled share; below 0 is 0, above 100 is full."""
    filled = F.greatest(F.lit(0), F.floor(F.least(percent / 100.0 * width, F.lit(float(width))))).cast("int")
    return F.rpad(F.repeat(F.lit("#"), filled), width, "-")


def truncated(text: Column, limit: int) -> Column:
    """The longest prefix of at most `limit` UTF-8 bytes that is valid text (a character has at most four)."""
    data = F.encode(text, "UTF-8")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*[F.try_validate_utf8(F.substring(data, 1, limit - k).cast("string")) for k in range(4)]))


def time_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def csv_cell(value: Column) -> Column:
    """A quoted CSV cell; quotes are doubled, null is empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
