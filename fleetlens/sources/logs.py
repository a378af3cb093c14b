"""Log sources: journal JSON lines and plain files, for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_COLUMNS = ("timestamp", "host", "seq", "source", "unit", "identifier", "systemd_unit", "priority", "message", "pid")


def _text(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "string")


def _valid(value: Column) -> Column:
    """An object whose MESSAGE is missing or a string, and whose timestamp is a usable number if it is there."""
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    message = F.coalesce(F.schema_of_variant(F.try_variant_get(value, "$.MESSAGE", "variant")), F.lit("VOID"))
    micros = _text(value, "__REALTIME_TIMESTAMP")
    return is_object & message.isin("STRING", "VOID") & (micros.isNull() | micros.try_cast("long").isNotNull())


def _unsigned(text: Column, limit: int) -> Column:
    number = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("long"))
    return F.when(number < limit, number).try_cast("int")


def journal(lines: DataFrame, now: Column) -> DataFrame:
    """Log rows from columns host, seq and value (a JSON line); lines that are no valid record are left out.

    Times are whole seconds; a record without a time gets `now`. A priority that is no number from 0 to 255 is 6, a
    process number that is none from 0 to 2**32 - 1 (or does not fit the column) is null, a missing message is ''.
    """
    v = F.col("_v")
    identifier, unit = _text(v, "SYSLOG_IDENTIFIER"), _text(v, "_SYSTEMD_UNIT")
    seconds = F.floor(_text(v, "__REALTIME_TIMESTAMP").try_cast("long") / F.lit(1_000_000))
    ts = F.coalesce(F.timestamp_seconds(seconds).cast("timestamp_ntz"), now.cast("timestamp_ntz"))
    rows = lines.withColumn("_v", F.try_parse_json("value")).filter(_valid(v))
    return rows.select(
        ts.alias("timestamp"),
        "host",
        "seq",
        F.lit("systemd").alias("source"),
        F.coalesce(identifier, unit).alias("unit"),
        identifier.alias("identifier"),
        unit.alias("systemd_unit"),
        F.coalesce(_unsigned(_text(v, "PRIORITY"), 2**8), F.lit(6)).alias("priority"),
        F.coalesce(_text(v, "MESSAGE"), F.lit("")).alias("message"),
        _unsigned(_text(v, "_PID"), 2**32).alias("pid"),
    )


def quarantined(lines: DataFrame) -> DataFrame:
    """The lines that journal() leaves out."""
    return lines.withColumn("_v", F.try_parse_json("value")).filter(~F.coalesce(_valid(F.col("_v")), F.lit(False))).drop("_v")


def file_lines(lines: DataFrame, now: Column) -> DataFrame:
    """Log rows from columns host, seq, path and value (a line of a plain file)."""
    none = F.lit(None).cast("string")
    return lines.select(now.cast("timestamp_ntz").alias("timestamp"), "host", "seq", F.col("path").alias("source"), none.alias("unit"), none.alias("identifier"), none.alias("systemd_unit"), F.lit(6).alias("priority"), F.col("value").alias("message"), F.lit(None).cast("int").alias("pid"))


def merged(journal_rows: DataFrame, *files: DataFrame) -> DataFrame:
    """Journal first, then files, by name of column."""
    out = journal_rows
    for f in files:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
