"""The table store: six Parquet tables by date behind a commit log, with appends, added columns, retention and compaction."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.timeutil import time_filter
from fleetlens.operators.commits import Conflict, Log, ReplacedWriter
from fleetlens.schemas import SCHEMAS


def fresh(df: DataFrame, now: datetime | str, max_age_seconds: int) -> DataFrame:
    """Rows that are not older than max_age_seconds; a row exactly that old stays. Older dates are not read."""
    return time_filter(df, datetime.fromisoformat(str(now)) - timedelta(seconds=int(max_age_seconds)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share; a local session may use its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/fleetlens-{name}-{uuid.uuid4().hex}"


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = part if out is None else out.unionAll(part)
    return out


#: What searches ask for: files are sorted by it when they are put together, and have bloom filters on it.
SOUGHT: dict[str, tuple[str, ...]] = {"logs": ("unit", "identifier"), "processes": ("name",), "containers": ("vmid",), "container_metrics": ("vmid",)}
TARGET_BYTES = 128 << 20


def bins(files: Iterable[tuple[str, str, int]], target: int) -> list[list[tuple[str, str, int]]]:
    """Files (path, date, bytes) of one date each put into as few groups as first fit, largest first, needs; single files are left out."""
    out: list[list[tuple[str, str, int]]] = []
    by_date: dict[str, list[tuple[str, str, int]]] = {}
    for f in files:
        if f[2] < target:
            by_date.setdefault(f[1], []).append(f)
    for date in sorted(by_date):
        open_: list[tuple[int, list[tuple[str, str, int]]]] = []
        for f in sorted(by_date[date], key=lambda x: (-x[2], x[0])):
            k = next((k for k, (size, _) in enumerate(open_) if size + f[2] <= target), None)
            if k is None:
                open_.append((f[2], [f]))
            else:
                open_[k] = (open_[k][0] + f[2], [*open_[k][1], f])
        out += [files for _, files in open_ if len(files) > 1]
    return out


@dataclass(frozen=True)
class Store:
    """The six tables, and one of dead letters, below `root`. `step` is told what a run is about to do, so that tests can end it there."""

    spark: SparkSession
    root: str
    step: Callable[[str], None] = lambda name: None

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def log(self, table: str) -> Log:
        return Log(self.spark, self.path(table), "date", self.step)

    def create(self) -> None:
        """Makes the tables that are absent."""
        for name in SCHEMAS:
            log = self.log(name)
            if not log.snapshot().version:
                log.commit("create")

    def read(self, table: str, since: datetime | str | None = None, until: datetime | str | None = None, version: int | None = None) -> DataFrame:
        """The table as it is now, or as it was after a commit; files written before a column was added give null for it.

        Bounds on time leave out files of other dates before Spark sees them; rows are filtered, too. What the frame
        reads stays the same whatever is committed afterwards, until vacuum() deletes replaced files.
        """
        log = self.log(table)
        files = log.live(log.snapshot(version), since and str(since)[:10], until and str(until)[:10])
        return time_filter(log.read([path for path, _, _ in files], SCHEMAS[table]), since, until)

    def append(self, table: str, rows: DataFrame, stream: str | None = None, number: int = -1, epoch: int = 0) -> bool:
        """Appends one tick's rows in one commit; columns are matched by name, missing ones are null, date follows timestamp.

        A stream's batch that is there already, as after a failure, is left out, also if its rows have been compacted
        or have aged out since: False. A row without host or time is an error, and nothing of its batch is written.
        """
        log = self.log(table)
        if stream is not None:
            now = log.snapshot()
            if now.epoch(stream) > epoch:
                raise ReplacedWriter(f"{stream}: epoch {epoch} was replaced by {now.epoch(stream)}")
            if number <= now.last(stream):
                return False
        have = set(rows.columns)
        bad = F.raise_error(F.lit(f"{table}: a row without host or time"))
        whole = F.col("host").isNotNull() & F.col("timestamp").isNotNull()
        cols = [F.when(whole, F.col("timestamp").cast("date")).otherwise(bad).alias("date") if f.name == "date" else (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMAS[table]]
        add = log.write(rows.select(*cols), self._options(table))
        return log.commit("append", add, stream=stream, number=number, epoch=epoch) is not None

    def views(self) -> None:
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(name)

    def retain(self, now: datetime, max_age: timedelta, tries: int = 10) -> None:
        """Drops what is older than max_age, beside appends and compaction: whole dates by the log alone, the boundary date by one rewrite."""
        cut = now - max_age
        day = f"{cut:%Y-%m-%d}"
        for name in SCHEMAS:
            log = self.log(name)
            for _ in range(tries):
                files = log.live(log.snapshot(), until=day)
                edge = [f for f in files if f[1] == day]
                rows = log.read([path for path, _, _ in edge], SCHEMAS[name])
                old = F.col("timestamp") < F.lit(str(cut)).cast("timestamp_ntz")
                if not edge or rows.filter(old).isEmpty():
                    edge = []
                remove = [f for f in files if f[1] < day] + edge
                if not remove:
                    break
                try:
                    log.commit("retain", log.write(rows.filter(~old), self._options(name)) if edge else [], remove)
                    break
                except Conflict:  # compacted meanwhile: begin again
                    continue
            else:
                raise Conflict(f"{name}: others kept replacing files")

    def compact(self, table: str, target: int = TARGET_BYTES, since: datetime | str | None = None, until: datetime | str | None = None, most: int = 10_000) -> int:
        """Puts small files of each date together, up to `target` bytes, and gives how many went; readers and appends go on.

        At most `most` files go in one commit, so that what a run that is cut off has done stays. Where retention took one of the
        files meanwhile, that commit is left out; the next run looks again.
        """
        log, gone = self.log(table), 0
        todo = bins(log.live(log.snapshot(), since and str(since)[:10], until and str(until)[:10]), target)
        while todo:
            part = [todo.pop()]
            while todo and sum(map(len, part)) + len(todo[-1]) <= most:
                part.append(todo.pop())
            files = [f for group in part for f in group]
            number = self.spark.createDataFrame([(path, k) for k, group in enumerate(part) for path, _, _ in group], "_path string, _bin int")
            # the metadata has to be asked for before the column of the commit is dropped
            paths = [f"{log.root}/data/{path}" for path, _, _ in files]
            schema = T.StructType([*SCHEMAS[table], T.StructField("commit", T.StringType())])
            rows = self.spark.read.schema(schema).option("basePath", f"{log.root}/data").parquet(*paths)
            rows = rows.withColumn("_path", F.regexp_extract(F.col("_metadata.file_path"), "/data/(commit=.*)$", 1)).drop("commit").join(F.broadcast(number), "_path")
            order = [*SOUGHT.get(table, ()), "host", "timestamp"]
            packed = rows.repartitionByRange(len(part), "_bin").sortWithinPartitions("date", *order).drop("_path", "_bin")
            try:
                log.commit("compact", log.write(packed, self._options(table)), files)
                gone += len(files)
            except Conflict:
                continue
        return gone

    def vacuum(self, before: datetime) -> None:
        """Deletes what no reader or writer that began after `before` (UTC) can want; see Log.vacuum."""
        for name in SCHEMAS:
            self.log(name).vacuum(before)

    @staticmethod
    def _options(table: str) -> dict[str, str]:
        return {f"parquet.bloom.filter.enabled#{c}": "true" for c in SOUGHT.get(table, ())}
