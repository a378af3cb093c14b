"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Every round is joins and minimum aggregates (a vertex's neighbours are never gathered), and is written to the shared
folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of edges (a, b: long) but the roots: root is the least vertex that v reaches.

    Repeated edges and loops make no difference; edges with a null end are ignored; no edges give no rows.
    """
    # rows that lie by a are counted once, grouped and joined on a without another shuffle
    once = lambda df: df.repartition("a").distinct()
    now = stored(once(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == mark or not seen["n"]:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
        mark = seen
        both = now.union(now.select("b", "a")).repartition("a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = once(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        now = stored(once(large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)), "stars")
    raise RuntimeError("components did not settle")
