"""What the corpus operators share: shared-folder tables, stable uniforms and word splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as a class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\f\r"

MIN_LONG = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may be without, as in
    tests: it takes a folder under its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")


#: Folders that were written, and the tables over them, in order.
_MADE: list[tuple[str, str | None]] = []


def made() -> int:
    """How many intermediate tables there have been; a mark for clear()."""
    return len(_MADE)


def clear(spark: SparkSession, since: int = 0, last: int = 0) -> None:
    """Deletes the intermediate tables written since a mark, but for the `last` ones.

    For when the results that read them are written themselves: operators return frames that are not computed yet.
    """
    gone = _MADE[since : len(_MADE) - last]
    for path, table in gone:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE[since : since + len(gone)] = []


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df once into the shared folder, in folders by a column's values if asked to, and reads it back: cuts lineage, and
    survives lost executors.

    The files stay until clear(), because the returned frame reads them lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fleetlens/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _MADE.append((path, None))
    return spark.read.schema(df.schema).parquet(path)


def private(name: str) -> str:
    """A name for a helper column beside a caller's own columns."""
    return f"_fleetlens_{name}"


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by a column, so that joins on it need no shuffle of this side."""
    spark = df.sparkSession
    table = f"fleetlens_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/fleetlens/{table}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    _MADE.append((path, table))
    return spark.table(table)


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """rows joined with counted, a stored frame, on keys; counted has one row for each key, and n, how many rows have it.

    No task gets a frequent key whole: keys of more than a `most`-th of the rows that are joined, of which there are at
    most `most` whatever the data, are joined by broadcast where their rows lie; all others as Spark sees fit.
    """
    seen = counted.agg(F.sum("n").alias("n"), F.max("n").alias("top")).first()
    limit = max(1000, (seen["n"] or 0) // most)
    if (seen["top"] or 0) <= limit:
        return rows.join(counted, keys)
    hot = counted.filter(F.col("n") > limit)
    rest = counted.filter(F.col("n") <= limit)
    cool = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cool)


def join_wide(rows: DataFrame, wide: DataFrame, key: str, by: str, each: int = 1000) -> DataFrame:
    """rows (a stored frame) joined with wide, which has one row for each key and is too large to broadcast.

    A row of wide that many rows ask for is copied once for each `each` of them, and the rows are dealt to the copies by
    the column `by`, so that no task gets a frequent key whole.
    """
    times = stored(rows.groupBy(key).agg(F.count("*").alias("n")), "asked-for")
    copies, copy = F.ceil(F.col("n") / each).cast("int"), private("copy")
    asking = join_counted(rows, times, [key]).select(*rows.columns, F.pmod(F.xxhash64(by), copies).cast("int").alias(copy))
    copied = times.join(wide, key).select(*wide.columns, F.explode(F.sequence(F.lit(0), copies - 1)).alias(copy))
    return asking.join(copied, [key, copy]).drop(copy)


def uniform(*cols: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns' values and the seed only, so that reruns agree."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Array of maximal runs without white space (SPACE_CLASS); empty for null or blank text."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACE_CLASS}]+"))


def word_count(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"[{SPACE_CLASS}]+"))).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
