"""Structured Streaming jobs: captures and logs into the tables, and rates from counters with keyed state.

Every table has its own query, so that one that fails does not stop the others. Sources are folders into which closed
files are dropped; maxFilesPerTrigger bounds a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetlens.operators.commits import Files
from fleetlens.operators.newest import Newest
from fleetlens.operators.payload import checked, dead_letters, flattened
from fleetlens.operators.store import Store
from fleetlens.schemas import SCHEMAS
from fleetlens.sources import logs

#: How long a key's last sample is kept without a new one.
STATE_TTL_MS = 7 * 86_400_000

RATES = T.StructType([T.StructField("host", T.StringType()), T.StructField("vmid", T.IntegerType()), T.StructField("timestamp", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("cpu_pct", T.DoubleType()), T.StructField("mem_current", T.LongType()), T.StructField("mem_max", T.LongType())])


def lines(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Lines of text files as they come: host (the folder below `folder`), path, seq and value.

    seq orders lines by the second of their file, then by a hash of its path, then by their number in it. A file is
    read as one value, so shippers close files at a bounded size, of less than a million lines; maxFilesPerTrigger
    bounds what a batch drains. sources.tail is the source for files that are still written to.
    """
    text = spark.readStream.option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    path, seconds = F.col("_metadata.file_path"), F.unix_seconds(F.col("_metadata.file_modification_time"))
    # 31 bits of seconds and 12 of the path above 20 of the line
    file = seconds * 2**12 + F.pmod(F.xxhash64(path), F.lit(2**12))
    numbered = F.transform(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n"), lambda x, i: F.struct(i.alias("n"), x.alias("value")))
    split = text.select(path.alias("path"), file.alias("_t"), F.explode(numbered).alias("x"))
    return split.select("x.value", "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("host"), (F.col("_t") * 2**20 + F.col("x.n")).alias("seq"))


def journal_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    return logs.journal(lines(spark, folder, per_trigger), F.current_timestamp())


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    return logs.file_lines(lines(spark, folder, per_trigger), F.current_timestamp())


def document_streams(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 1000) -> dict[str, DataFrame]:
    """Rows of the six tables out of the documents that hosts drop, one in a line, and dead letters; each is a stream of its own."""
    documents = lines(spark, folder, per_trigger).withColumnRenamed("value", "document")
    return flattened(documents, schema) | {"dead_letters": dead_letters(documents, schema).withColumn("timestamp", F.current_timestamp().cast("timestamp_ntz"))}


def replay(store: Store, schema: T.StructType, repair: Callable[[DataFrame], DataFrame] = lambda d: d, version: int | None = None) -> int:
    """Takes dead letters apart again, once `repair` has changed their documents or the schema has grown; gives the version replayed.

    What is still wrong stays a dead letter. A replay that was cut off is finished by another one of the same version.
    """
    log = store.log("dead_letters")
    now = log.snapshot(version)
    files = log.live(now)
    if not files:
        return now.version
    documents = repair(store.read("dead_letters", version=now.version))
    for name, rows in flattened(documents, schema).items():
        store.append(name, rows, "replay", now.version)
    still = checked(documents, schema).filter("reason IS NOT NULL").select(*[f.name for f in SCHEMAS["dead_letters"]])
    log.commit("replay", log.write(still), files)
    return now.version


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A stream's name, which lies in its checkpoint and is made with it: a stream that lost its checkpoint is another one."""
    files, path = Files(spark), f"{checkpoint}/stream-id"
    files.write_new(path, uuid.uuid4().hex)
    return files.read(path).strip()


def append(rows: DataFrame, store: Store, table: str, checkpoint: str, every: str | None = "10 seconds") -> StreamingQuery:
    """Appends each batch to a table; every=None works off what is there and stops.

    A batch is one commit under the stream's name and the batch's number, so one that is run again after a failure is
    there once, whatever retention or compaction did meanwhile. A run that starts takes the stream over from one that still goes.
    """
    at = f"{checkpoint}/{table}"
    stream = stream_id(rows.sparkSession, at)
    epoch = store.log(table).begin(stream)

    def write(batch: DataFrame, number: int) -> None:
        if not store.append(table, batch, stream, number, epoch):
            batch.write.format("noop").mode("overwrite").save()  # keyed state, if there is any, has to move on

    out = rows.writeStream.queryName(f"append-{table}-{stream[:8]}").foreachBatch(write).option("checkpointLocation", f"{at}/spark")
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def keep_newest(rows: DataFrame, newest: Newest, checkpoint: str, every: str | None = "10 seconds") -> StreamingQuery:
    """Takes each batch into a table of newest snapshots; a batch that is run again, or comes late, changes nothing."""
    stream = stream_id(rows.sparkSession, checkpoint)
    epoch = newest.log().begin(stream)

    def write(batch: DataFrame, number: int) -> None:
        newest.update(batch, stream, number, epoch)

    out = rows.writeStream.queryName(f"newest-{stream[:8]}").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/spark")
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def append_all(tables: dict[str, DataFrame], store: Store, checkpoint: str, every: str | None = "10 seconds") -> dict[str, StreamingQuery]:
    """One query for each table; one that fails leaves the others running."""
    return {name: append(rows, store, name, checkpoint, every) for name, rows in tables.items()}


class _Sampled(StatefulProcessor):
    """Rows of one bucket of a host's keys against the previous sample of each key, over batches and restarts.

    The state is one value for a bucket: for each key its last sample's time, its first one's, and its counters. So
    Python is called once for a bucket, not once for a key. Keys without a sample for `keep_s` seconds of the bucket's own time
    are forgotten, so that ended processes take no room; a bucket that is silent for `ttl_ms` is forgotten whole.
    """

    def __init__(self, counters: list[str], formula: Callable[..., dict[str, Any]], columns: list[str], keep_s: int, ttl_ms: int | None) -> None:
        self.counters, self.formula, self.columns, self.keep_s, self.ttl_ms = counters, formula, columns, keep_s, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("samples", "ids array<string>, micros array<bigint>, firsts array<bigint>, counters array<bigint>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # one bucket's rows of one batch, which the source bounds
        got = pd.concat(list(rows), ignore_index=True).sort_values(["timestamp", "seq"], ignore_index=True)
        ids = got["key_name"]
        k = len(self.counters)
        now = pd.DataFrame({"micros": got["timestamp"].astype("datetime64[us]").astype("int64")} | {c: got[c].astype("int64") for c in self.counters})
        now["first"] = now["micros"]
        if self.last.exists():
            old_ids, micros, firsts, counters = self.last.get()
            before = pd.DataFrame(np.array(counters, np.int64).reshape(-1, k), columns=self.counters).assign(micros=micros, first=firsts)
            old = pd.Series(list(old_ids), dtype=object)
        else:
            before, old = now.iloc[:0], pd.Series([], dtype=object)
        # the last samples stand before the new ones of their keys
        both, whose = pd.concat([before[now.columns], now], ignore_index=True), pd.concat([old, ids], ignore_index=True)
        both["first"] = both.groupby(whose)["first"].transform("first")
        prior = both.groupby(whose).shift(1).iloc[len(before) :].reset_index(drop=True)
        now["first"] = both["first"].iloc[len(before) :].to_numpy()
        has = prior["micros"].notna().to_numpy()
        seconds = np.where(has, (now["micros"] - prior["micros"].fillna(0)) / 1_000_000.0, 0.0)
        # what is forgotten does not depend on where batches end
        has &= seconds <= self.keep_s
        seconds = np.where(has, seconds, 0.0)
        grown = {c: np.where(has, np.maximum(now[c] - prior[c].fillna(0), 0), 0) for c in self.counters}
        kept = both.groupby(whose).tail(1)
        kept = kept[kept["micros"] >= both["micros"].max() - self.keep_s * 1_000_000]
        self.last.update((list(whose[kept.index]), [int(x) for x in kept["micros"]], [int(x) for x in kept["first"]], [int(x) for x in kept[self.counters].to_numpy().ravel()]))
        yield got.assign(**self.formula(has, seconds, grown, now))[self.columns]

    def close(self) -> None:
        pass


def _host_formula(has: np.ndarray, seconds: np.ndarray, grown: dict[str, np.ndarray], now: pd.DataFrame) -> dict[str, Any]:
    total = sum(grown.values()).astype(float)
    share = lambda x: np.divide(100.0 * x, total, out=np.zeros(len(total)), where=total > 0)
    return {"cpu_percent": share(total - grown["c_idle"]), "cpu_user": share(grown["c_user"] + grown["c_nice"]), "cpu_system": share(grown["c_system"]), "cpu_iowait": share(grown["c_iowait"])}


def _process_formula(has: np.ndarray, seconds: np.ndarray, grown: dict[str, np.ndarray], now: pd.DataFrame) -> dict[str, Any]:
    return {"cpu_percent": np.divide(100.0 * grown["jiffies"], 100.0 * seconds, out=np.zeros(len(has)), where=seconds > 0)}


def _self_formula(has: np.ndarray, seconds: np.ndarray, grown: dict[str, np.ndarray], now: pd.DataFrame) -> dict[str, Any]:
    rate = np.divide(grown["jiffies"] / 100.0, seconds, out=np.zeros(len(has)), where=seconds > 0) * 100.0
    return {"cpu_percent": rate, "uptime_seconds": (now["micros"] - now["first"]) // 1_000_000}


def _container_formula(has: np.ndarray, seconds: np.ndarray, grown: dict[str, np.ndarray], now: pd.DataFrame) -> dict[str, Any]:
    there = has & (seconds > 0)
    rate = np.divide(grown["usage_usec"], seconds * 1_000_000.0, out=np.zeros(len(has)), where=there) * 100.0
    return {"cpu_pct": pd.arrays.FloatingArray(rate, ~there)}


#: Into how many buckets the keys of a host are dealt; what a stream's state has been begun with, it has to be gone on with.
BUCKETS = 16


def _sampled(rows: DataFrame, keys: list[str], counters: list[str], formula: Callable[..., dict[str, Any]], out: list[tuple[str, T.DataType]], keep_s: int, ttl_ms: int | None) -> DataFrame:
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    schema = T.StructType([*[f for f in rows.schema if f.name not in dict(out)], *[T.StructField(n, t) for n, t in out]])
    processor = _Sampled(counters, formula, schema.names, keep_s, ttl_ms)
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
    # Spark gives columns whose names begin with an underscore other names in Python
    dealt = rows.withColumn("key_name", name).withColumn("key_bucket", F.pmod(F.xxhash64("key_name"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("host", "key_bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def container_rates(counters: DataFrame, ttl_ms: int | None = STATE_TTL_MS) -> DataFrame:
    """Streaming form of operators.derive.container_rates, null for a container's first sample; needs the RocksDB state store.

    A container without a sample for `ttl_ms` of its bucket's own time is forgotten.
    With a time to live Spark goes on running empty batches, so a run that shall end by itself takes None.
    """
    rows = counters.select("host", "vmid", "timestamp", "seq", "usage_usec", "mem_current", "mem_max")
    made = _sampled(rows, ["vmid"], ["usage_usec"], _container_formula, [("cpu_pct", T.DoubleType())], ttl_ms // 1000 if ttl_ms else 2**40, ttl_ms)
    return made.select(*[F.col(f.name).cast(f.dataType) for f in RATES])


_DOUBLE, _LONG = T.DoubleType(), T.LongType()


def host_rates(counters: DataFrame, ttl_ms: int | None = STATE_TTL_MS) -> DataFrame:
    """Streaming form of operators.derive.cpu_rates: 0.0 for a host's first sample or without progress."""
    names = [c for c in ("c_user", "c_nice", "c_system", "c_idle", "c_iowait", "c_irq", "c_softirq", "c_steal") if c in counters.columns]
    return _sampled(counters, [], names, _host_formula, [(c, _DOUBLE) for c in ("cpu_percent", "cpu_user", "cpu_system", "cpu_iowait")], 2**40, ttl_ms)


def process_rates(samples: DataFrame, keep_s: int = 600, ttl_ms: int | None = STATE_TTL_MS) -> DataFrame:
    """Streaming form of operators.derive.process_rates, by host and pid, and by `started` where there is such a column.

    A pid that is used again starts anew if `started` tells so; without it, its counter has gone back and has grown by 0.
    A process without a sample for `keep_s` seconds is forgotten.
    """
    return _sampled(samples, ["pid", *[c for c in ("started",) if c in samples.columns]], ["jiffies"], _process_formula, [("cpu_percent", _DOUBLE)], keep_s, ttl_ms)


def self_rates(samples: DataFrame, ttl_ms: int | None = STATE_TTL_MS) -> DataFrame:
    """Streaming form of operators.derive.self_rates; uptime counts from the first sample, over restarts of the stream."""
    return _sampled(samples, [], ["jiffies"], _self_formula, [("cpu_percent", _DOUBLE), ("uptime_seconds", _LONG)], 2**40, ttl_ms)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
