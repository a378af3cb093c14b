"""Telemetry-shaped views over the given tables, as SQL that Spark and DuckDB both run ({ts}: the timestamp type)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "fx_logs": """
SELECT CAST(date_trunc('second', ts) AS {ts}) AS timestamp, 'host-' || CAST(user_id % 16 AS STRING) AS host, event_id AS seq,
  'systemd' AS source,
  COALESCE(CASE WHEN event_type <> 'click' THEN event_type END, CASE WHEN event_id % 10 <> 0 THEN event_type || '.service' END) AS unit,
  CASE WHEN event_type <> 'click' THEN event_type END AS identifier,
  CASE WHEN event_id % 10 <> 0 THEN event_type || '.service' END AS systemd_unit,
  CAST(event_id % 8 AS INT) AS priority, props AS message,
  CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS INT) END AS pid
FROM events""",
    "fx_metrics": """
SELECT ts AS timestamp, 'host-' || CAST(user_id % 16 AS STRING) AS host, event_id AS seq,
  LEAST(value / 5.0, 100.0) AS cpu_percent, LEAST(value / 10.0, 50.0) AS cpu_user, LEAST(value / 20.0, 25.0) AS cpu_system,
  CAST(event_id % 3 AS DOUBLE) AS cpu_iowait, CAST(16000000000 AS BIGINT) AS mem_total,
  CAST(1500000000 + event_id * 1000 AS BIGINT) AS mem_used,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE 10.0 + CAST(event_id % 50 AS DOUBLE) END AS mem_percent,
  CASE WHEN user_id % 4 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(4000000000 AS BIGINT) END AS swap_total,
  CASE WHEN user_id % 4 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(event_id * 1000 AS BIGINT) END AS swap_used
FROM events""",
    "fx_counters": """
SELECT ts AS timestamp, 'host-' || CAST(user_id % 16 AS STRING) AS host, event_id AS seq, CAST(floor(user_id / 16) AS INT) AS vmid,
  CAST(SUM(CAST(floor(value) AS BIGINT)) OVER h AS BIGINT) AS c_user, CAST(0 AS BIGINT) AS c_nice,
  CAST(SUM(event_id % 7) OVER h AS BIGINT) AS c_system, CAST(SUM(event_id % 50) OVER h AS BIGINT) AS c_idle,
  CAST(SUM(event_id % 3) OVER h AS BIGINT) AS c_iowait,
  CAST(SUM(CAST(floor(value * 1000) AS BIGINT)) OVER v AS BIGINT) % 1000000 AS usage_usec,
  1000000 + event_id AS mem_current, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(8589934592 AS BIGINT) END AS mem_max
FROM events WINDOW h AS (PARTITION BY user_id % 16 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "fx_processes": """
SELECT CAST(date_trunc('month', l_shipdate) AS {ts}) AS timestamp, 'host-' || CAST(l_suppkey % 16 AS STRING) AS host,
  CAST(l_orderkey * 8 + l_linenumber AS INT) AS pid, 'process-' || CAST(l_partkey % 50 AS STRING) AS name,
  '/usr/bin/process-' || CAST(l_partkey % 50 AS STRING) || ' --flag=' || CAST(l_linenumber AS STRING) AS cmdline,
  l_linestatus AS state, l_discount * 100 + l_tax * 10 AS cpu_percent, CAST(floor(l_extendedprice) AS BIGINT) * 1024 AS mem_rss,
  l_linenumber AS threads, CAST(floor(l_suppkey / 16) AS BIGINT) AS uid
FROM lineitem""",
    "fx_passwd": """
SELECT 'host-' || CAST(s_suppkey % 16 AS STRING) AS host, CAST(floor(s_suppkey / 16) AS BIGINT) AS uid, s_name AS username
FROM supplier WHERE s_suppkey % 5 <> 0""",
    "fx_disks": """
SELECT {ts} '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(s_suppkey % 5 AS INT) AS timestamp, 'host-' || CAST(s_suppkey % 16 AS STRING) AS host,
  '/mount-' || CAST(r_regionkey AS STRING) || '-' || CAST(s_suppkey AS STRING) AS mount_point, '/dev/sd' || CAST(r_regionkey AS STRING) AS filesystem,
  CAST(100000000000 AS BIGINT) AS total_bytes, CAST(50000000000 + s_suppkey * 100000000 AS BIGINT) AS used_bytes,
  CAST(50000000000 + s_suppkey * 100000000 AS DOUBLE) * 100 / 100000000000 AS percent
FROM supplier CROSS JOIN region""",
    "fx_mounts": """
SELECT 'host-' || CAST(CAST(floor(page_id / 40) AS BIGINT) AS STRING) AS host, {ts} '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(page_id % 2 AS INT) AS timestamp,
  page_id AS line_no, regexp_extract(url, '^https?://([^/?#]+)', 1) AS device,
  COALESCE(NULLIF(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS mount_point,
  CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 'tmpfs' WHEN 1 THEN 'cgroup2' ELSE 'ext4' END AS fstype,
  1000 + page_id AS f_blocks, 200 + page_id % 300 AS f_bfree, CAST(4096 AS BIGINT) AS f_frsize
FROM pages""",
    "fx_guests": """
SELECT CAST(c_custkey AS INT) AS vmid, c_name AS name, 'node-' || CAST(c_nationkey AS STRING) AS node,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'lxc' WHEN 'BUILDING' THEN 'qemu' WHEN 'MACHINERY' THEN 'storage' ELSE 'lxc' END AS type,
  CASE WHEN c_acctbal < 0 THEN 'stopped' ELSE 'running' END AS status, c_custkey * 1048576 AS maxmem,
  CAST(c_custkey % 8 + 1 AS DOUBLE) AS maxcpu, CASE WHEN c_acctbal < 0 THEN CAST(0 AS BIGINT) ELSE c_custkey * 60 END AS uptime
FROM customer""",
    "fx_inventory": """
SELECT ts AS timestamp, 'host-' || CAST(user_id % 16 AS STRING) AS host, CAST(floor(user_id / 16) AS INT) AS vmid,
  'guest-' || CAST(user_id AS STRING) AS name, 'node-' || CAST(user_id % 25 AS STRING) AS node,
  CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'qemu' WHEN 1 THEN 'storage' ELSE 'lxc' END AS type,
  CASE WHEN event_id % 3 = 0 THEN 'stopped' ELSE 'running' END AS status
FROM events""",
}

_TABLE = re.compile(r"\b(FROM|JOIN)\s+(events|lineitem|supplier|region|pages|customer)\b")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the tables are passed in, so nothing is registered in the session."""
    sql = VIEWS[name].replace("{ts}", "timestamp_ntz")
    tables = {m[2] for m in _TABLE.finditer(sql)}
    sql = _TABLE.sub(r"\1 {\2}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def duck(*names: str) -> str:
    """The views as a WITH clause for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('{ts}', 'timestamp')})" for n in names)
