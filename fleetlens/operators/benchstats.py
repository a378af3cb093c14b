"""Statistics of resource samples: exact ranks, a comparison of two builds, and a pass/fail gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def samples(lines: DataFrame) -> DataFrame:
    """cpu and rss_kb of lines '<cpu> <rss>' in value, beside the other columns; blank and malformed lines are dropped."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.select(*[c for c in lines.columns if c != "value"], F.get(p, F.lit(0)).try_cast("double").alias("cpu"), F.get(p, F.lit(1)).try_cast("long").alias("rss_kb")).dropna(subset=["cpu", "rss_kb"])


def read_samples(spark, path: str) -> DataFrame:
    return samples(spark.read.text(path))


def stats(samples: DataFrame, by: str = "label") -> DataFrame:
    """n, mean, p50, p99, max cpu and max resident MB of each label.

    p50 and p99 are the sorted samples' elements n // 2 and int(0.99 n), counted from 0. Equal values are counted
    first, so only distinct values are ordered.
    """
    whole = samples.groupBy(by).agg(F.count("*").alias("n"), F.avg("cpu").alias("mean"), F.max("cpu").alias("max_cpu"), (F.max("rss_kb") / F.lit(1024.0)).alias("rss_mb"))
    values = samples.groupBy(by, "cpu").agg(F.count("*").alias("c"))
    ends = values.withColumn("upto", F.sum("c").over(Window.partitionBy(by).orderBy("cpu").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("cpu")))
    ranks = ends.join(whole.select(by, "n"), by).groupBy(by).agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * F.lit(0.99).cast("double"))).alias("p99"))
    return whole.join(ranks, by).select(by, "n", "mean", "p50", "p99", "max_cpu", "rss_mb")


def delta(rows: DataFrame, a: str, b: str, by: str = "label") -> DataFrame:
    """By how many percent b's mean is below a's, and whether that is a reduction; no row unless a's mean is above 0."""
    two = rows.agg(F.max(F.when(F.col(by) == a, F.col("mean"))).alias("mean_a"), F.max(F.when(F.col(by) == b, F.col("mean"))).alias("mean_b"))
    return two.filter("mean_a > 0").withColumn("delta_pct", (F.col("mean_a") - F.col("mean_b")) / F.col("mean_a") * 100).withColumn("verdict", F.when(F.col("delta_pct") > 0, "reduction").otherwise("regression"))


def gate(rows: DataFrame, max_rss_kb: int = 51_200, max_cpu: float = 2.0) -> DataFrame:
    """PASS or FAIL for each host's largest figures."""
    most = rows.groupBy("host").agg(F.max("rss_kb").alias("rss_kb"), F.max("cpu").alias("cpu"))
    return most.withColumn("verdict", F.when((F.col("rss_kb") > max_rss_kb) | (F.col("cpu") > max_cpu), "FAIL").otherwise("PASS"))
