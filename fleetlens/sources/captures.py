"""Parsers of raw captures (host, timestamp, path, content) to typed rows; declarative, malformed rows are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions.scalars import truncated

KEYS = ("host", "timestamp")
CPU_FIELDS = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")
# File system types, by prefix, that are no disks.
PSEUDO_FILESYSTEMS = ("tmpfs", "devtmpfs", "sysfs", "proc", "devpts", "cgroup", "securityfs", "pstore", "autofs", "mqueue", "hugetlbfs", "debugfs", "tracefs", "fusectl", "configfs", "bpf", "binfmt", "selinux")


def _number(text: Column) -> Column:
    return text.try_cast("long")


def _keyed_number(content: Column, key: str, sep: str = r":\s*") -> Column:
    """The number after a key at the start of a line, or null."""
    return F.nullif(F.regexp_extract(content, rf"(?m)^{key}{sep}(\d+)", 1), F.lit("")).try_cast("long")


def cpu_counters(captures: DataFrame) -> DataFrame:
    """c_* counters and their total from the first line of a CPU statistics capture; steal may be missing (0)."""
    line = F.substring_index("content", "\n", 1)
    parts = F.split(F.trim(F.regexp_replace(line, r" +", " ")), " ")
    rows = captures.filter(line.startswith("cpu")).withColumn("_p", parts)
    fields = [_number(F.get("_p", F.lit(k + 1))).alias(f"c_{f}") for k, f in enumerate(CPU_FIELDS)]
    fields[-1] = F.coalesce(_number(F.get("_p", F.lit(8))), F.lit(0).cast("long")).alias("c_steal")
    out = rows.select(*KEYS, *[c for c in rows.columns if c in ("seq",)], *fields).dropna(subset=[f"c_{f}" for f in CPU_FIELDS[:-1]])
    total = F.col("c_user")
    for f in CPU_FIELDS[1:]:
        total = total + F.col(f"c_{f}")
    return out.withColumn("c_total", total)


def meminfo(captures: DataFrame) -> DataFrame:
    """Bytes of total, available, swap total and swap free memory; absent keys are 0."""
    get = lambda key: F.coalesce(_keyed_number(F.col("content"), key) * 1024, F.lit(0).cast("long"))
    return captures.select(*KEYS, *[c for c in captures.columns if c == "seq"], get("MemTotal").alias("mem_total"), get("MemAvailable").alias("mem_available"), get("SwapTotal").alias("swap_total"), get("SwapFree").alias("swap_free"))


def pid_stat(captures: DataFrame, page_size: int = 4096) -> DataFrame:
    """Process statistics: the name lies between the first '(' and the last ')', which may themselves be in the name."""
    keys = [*KEYS, *[c for c in captures.columns if c == "seq"]]
    pid, rest = F.substring_index("content", " ", 1), F.substring_index("content", ") ", -1)
    name = F.substr("content", F.length(pid) + 3, F.length("content") - F.length(pid) - F.length(rest) - 4)
    parts = F.split(rest, " ")
    figures = F.struct(
        pid.try_cast("int").alias("pid"),
        name.alias("name"),
        F.get("parts", F.lit(0)).alias("state"),
        _number(F.get("parts", F.lit(11))).alias("utime"),
        _number(F.get("parts", F.lit(12))).alias("stime"),
        F.get("parts", F.lit(17)).try_cast("int").alias("threads"),
        (_number(F.get("parts", F.lit(21))) * page_size).alias("mem_rss"),
    )
    # generators of one row: the split and the figures are made once, also for the filter that follows
    rows = captures.filter(F.col("content").rlike(r"(?s)^\d+ \(.*\) \S")).select(*keys, "content", F.explode(F.array(parts)).alias("parts")).select(*keys, F.inline(F.array(figures)))
    return rows.dropna(subset=["pid", "state", "utime", "stime", "threads", "mem_rss"])


def cmdline(content: Column) -> Column:
    """Arguments joined by spaces; unreadable (null) is empty."""
    return F.coalesce(F.rtrim(F.replace(content, F.lit("\0"), F.lit(" "))), F.lit(""))


def uid(content: Column) -> Column:
    """The first number after 'Uid:'; 0 where it is missing, null where the capture is."""
    return F.when(content.isNotNull(), F.coalesce(_keyed_number(content, "Uid", r":\t"), F.lit(0).cast("long")))


def passwd(captures: DataFrame) -> DataFrame:
    """(host, uid, username) of account lines; the first line of a uid wins, empty fields collapse."""
    lines = captures.select("host", F.posexplode(F.split("content", "\n")).alias("line", "body"))
    parts = lines.withColumn("_p", F.filter(F.split("body", ":"), lambda x: x != "")).select("host", "line", F.get("_p", F.lit(2)).try_cast("long").alias("uid"), F.get("_p", F.lit(0)).alias("username"))
    first = Window.partitionBy("host", "uid").orderBy("line")
    return parts.filter("uid IS NOT NULL").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("host", "uid", "username")


def mounts(captures: DataFrame) -> DataFrame:
    """(device, mount_point, fstype, line_no) of a mount table's lines; blank and short lines are skipped."""
    lines = captures.select(*KEYS, F.posexplode(F.split("content", "\n")).alias("line_no", "body"))
    parts = lines.withColumn("_p", F.split(F.trim("body"), r"[ \t]+")).filter(F.size("_p") >= 3)
    return parts.select(*KEYS, "line_no", F.get("_p", F.lit(0)).alias("device"), F.get("_p", F.lit(1)).alias("mount_point"), F.get("_p", F.lit(2)).alias("fstype"))


def real_filesystem(fstype: Column) -> Column:
    return ~fstype.rlike("^(" + "|".join(PSEUDO_FILESYSTEMS) + ")")


def cgroup_vmid(content: Column) -> Column:
    """The container id, from 0 to 2**32 - 1, in a control-group path; the container part must follow the colon."""
    number = F.nullif(F.regexp_extract(content, r":/(?:lxc/|lxc\.payload\.)(\d+)", 1), F.lit("")).try_cast("long")
    return F.when(number < 2**32, number)


def first_line(content: Column) -> Column:
    """A version line: first line, trimmed, at most 256 bytes, 'unknown' if blank or missing."""
    return hostname(F.substring_index(content, "\n", 1))


def hostname(content: Column) -> Column:
    """A host's name: the whole content, trimmed, at most 256 bytes, 'unknown' if blank or missing."""
    trimmed = F.btrim(content, F.lit(" \t\r\n"))
    return F.coalesce(F.nullif(truncated(trimmed, 256), F.lit("")), F.lit("unknown"))


def runtime(cgroup: Column, has_cluster_dir: Column, node: Column, version: Column) -> Column:
    """struct(kind, node, version, vmid): a container if its cgroup says so, else a host with a cluster, else none."""
    vmid = cgroup_vmid(cgroup)
    none = F.lit(None).cast("string")
    kind = F.when(vmid.isNotNull(), "container").when(has_cluster_dir, "host").otherwise("none")
    on_host = vmid.isNull() & has_cluster_dir
    return F.struct(kind.alias("kind"), F.when(on_host, hostname(node)).otherwise(none).alias("node"), F.when(on_host, first_line(version)).otherwise(none).alias("version"), vmid.alias("vmid"))


def cgroup_counters(cpu: DataFrame, current: DataFrame, most: DataFrame) -> DataFrame:
    """(host, timestamp, vmid, usage_usec, mem_current, mem_max) from three captures of a container's control group.

    A container without readable CPU or memory counters is dropped; an unreadable or unlimited ('max') limit is null.
    """
    keys = [*KEYS, "vmid"]
    usage = cpu.select(*keys, _keyed_number(F.col("content"), "usage_usec", " ").alias("usage_usec")).dropna(subset=["usage_usec"])
    memory = current.select(*keys, _number(F.trim("content")).alias("mem_current")).dropna(subset=["mem_current"])
    limit = most.select(*keys, F.when(F.trim("content") != "max", _number(F.trim("content"))).alias("mem_max"))
    return usage.join(memory, keys).join(limit, keys, "left")


def self_status(stat: Column, status: Column) -> Column:
    """struct of the agent's own figures: cpu jiffies, resident and virtual bytes, threads, two context-switch counts."""
    after = F.split(F.regexp_extract(stat, r"(?s)^.*\) (.*)$", 1), " ")
    get = lambda key, scale=1: F.coalesce(_keyed_number(status, key) * scale, F.lit(0).cast("long"))
    jiffies = F.coalesce(_number(F.get(after, F.lit(11))) + _number(F.get(after, F.lit(12))), F.lit(0).cast("long"))
    return F.struct(jiffies.alias("jiffies"), get("VmRSS", 1024).alias("rss_bytes"), get("VmSize", 1024).alias("vm_bytes"), get("Threads").alias("threads"), get("voluntary_ctxt_switches").alias("voluntary"), get("nonvoluntary_ctxt_switches").alias("involuntary"))


def disk_usage(df: DataFrame) -> DataFrame:
    """total_bytes, used_bytes and percent from f_blocks, f_bfree and f_frsize."""
    total = F.col("f_blocks") * F.col("f_frsize")
    used = F.greatest(total - F.col("f_bfree") * F.col("f_frsize"), F.lit(0).cast("long"))
    return df.withColumns({"total_bytes": total, "used_bytes": used}).withColumn("percent", F.when(F.col("total_bytes") > 0, F.col("used_bytes").cast("double") * 100 / F.col("total_bytes")).otherwise(F.lit(0.0)))
