"""A maintained table of each host's newest snapshot, so that asking for it reads no history.

Rows lie in buckets of hosts behind a commit log. An update rewrites the buckets whose hosts the batch has newer rows of,
in one commit under the stream's name and number, and leaves the others alone; rows older than what a host has are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from fleetlens.operators.commits import Conflict, Log, ReplacedWriter


@dataclass(frozen=True)
class Newest:
    """Newest snapshots of a table with host and timestamp, below `root`. The number of buckets stays what it was at first."""

    spark: SparkSession
    root: str
    schema: StructType
    buckets: int = 64

    def log(self) -> Log:
        return Log(self.spark, self.root, "bucket")

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.log().read(paths, StructType([*self.schema, StructField("bucket", IntegerType())]))

    def read(self) -> DataFrame:
        """The newest snapshot of every host."""
        log = self.log()
        return self._rows([path for path, _, _ in log.live(log.snapshot())]).drop("bucket")

    def update(self, rows: DataFrame, stream: str | None = None, number: int = -1, epoch: int = 0, tries: int = 10) -> bool:
        """Takes in a batch; False if it was there already. Rows as new as those of their host stand beside them."""
        columns, new, touched, aside = [f.name for f in self.schema], None, [], []
        for _ in range(tries):
            log = self.log()
            now = log.snapshot()
            if stream is not None and now.epoch(stream) > epoch:
                raise ReplacedWriter(f"{stream}: epoch {epoch} was replaced by {now.epoch(stream)}")
            if stream is not None and number <= now.last(stream):
                return False
            if new is None:  # a batch that is there already is not read
                # the newest times are written aside: their size is known then, so that few of them are broadcast and the
                # batch's rows are not shuffled, and what comes after reads the batch once. vacuum() deletes what is left of them.
                every, bucket = rows.select(*columns), F.pmod(F.xxhash64("host"), F.lit(self.buckets)).cast("int")
                times = every.filter("host IS NOT NULL").groupBy("host").agg(F.max("timestamp").alias("timestamp")).filter("timestamp IS NOT NULL")
                aside = log.write(times.withColumn("bucket", bucket).repartition("bucket"))
                few = log.read([f["path"] for f in aside], StructType([self.schema["host"], self.schema["timestamp"], StructField("bucket", IntegerType())]))
                new, touched = every.join(few.drop("bucket"), ["host", "timestamp"], "left_semi").withColumn("bucket", bucket), sorted({int(f["part"]) for f in aside})
            have = [f for f in log.live(now) if f[1].isdigit() and int(f[1]) in set(touched)]
            both = self._rows([path for path, _, _ in have]).unionByName(new)
            of_host = Window.partitionBy("bucket", "host")
            kept = both.withColumn("_newest", F.max("timestamp").over(of_host)).filter("timestamp = _newest").drop("_newest")
            try:
                add = log.write(kept.repartition(max(len(touched), 1), "bucket")) if touched else []
                done = log.commit("upsert", add, have, stream, number, epoch) is not None
                for folder in {f["path"].split("/")[0] for f in aside}:
                    log.files.delete(f"{log.root}/data/{folder}")
                return done
            except Conflict:  # another stream took the same buckets in hand
                continue
        raise Conflict(f"{self.root}: others kept replacing buckets")
