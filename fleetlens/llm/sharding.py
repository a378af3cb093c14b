"""Sharding by sampled splitters: equal bytes per shard, native DataFrame operations only.

A size-weighted sample of keys gives quantile boundaries; records are range-partitioned by them, ranges that turn out
overfull are subdivided by a sample of their own, and exact range totals turn positions inside ranges into global
byte offsets. A shard is an interval of those offsets, so shards differ by about one document at most, whatever the
sample was. Only narrow rows (key, size, checksum) are shuffled, never texts.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import MIN_LONG, stored, uniform

Bound = tuple[str, int, int]


def _range_of(bounds: list[Bound]) -> Column:
    """Index of the range that a row's (_key, _oid, _tie) falls in: a balanced tree of comparisons."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        k, o, t = bounds[mid]
        key, oid, tie = F.col("_key"), F.col("_oid"), F.col("_tie")
        below = (key < k) | ((key == k) & ((oid < o) | ((oid == o) & (tie < t))))
        return F.when(below, tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def _quantiles(sample: list[tuple[Bound, float]], pieces: int) -> list[Bound]:
    """pieces - 1 boundaries that cut the weighted sample into pieces of about equal weight."""
    sample = sorted(sample)
    total, seen, cuts = sum(w for _, w in sample), 0.0, []
    for bound, w in sample:
        if len(cuts) < pieces - 1 and seen >= total * (len(cuts) + 1) / pieces:
            cuts.append(bound)
        seen += w
    return sorted(set(cuts))


def _sampled(rows: DataFrame, expected: float, total: int, seed: int) -> list[tuple[Bound, float]]:
    """Keys drawn with chance in proportion to size, each with the size it stands for; about `expected` of them."""
    step = max(1.0, total / expected)
    got = rows.filter(uniform("_key", "_oid", "_tie", seed=seed) * step < F.col("_size")).select("_key", "_oid", "_tie", "_size").collect()
    return [((r["_key"], r["_oid"], r["_tie"]), max(step, float(r["_size"]))) for r in got]


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, ranges: int | None = None, per_range: int = 24, rounds: int = 3) -> DataFrame:
    """Puts each row of docs (doc_id, text) into a shard; shards are near equal in bytes (UTF-8 bytes of text plus 16).

    Order is (md5 of text, doc_id), so equal texts are neighbours unless a shard boundary cuts their group.
    ranges, per_range: how many ranges (if not given, one for a million rows, from 160 to 640), and sampled keys for each,
    which bound what reaches the driver. A range that has more than three times its part of the rows or of the bytes is
    subdivided.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, one row per input row.
    Null text counts as no bytes (size 16, checksum 0); null doc_id sorts first; repeated rows are each placed; a text
    longer than a shard leaves neighbouring shards empty; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 16).alias("_size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("_key"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)).alias("_oid"),
            F.monotonically_increasing_id().alias("_tie"),
        ),
        "shard-keys",
    )
    whole = narrow.agg(F.count("*").alias("n"), F.coalesce(F.sum("_size"), F.lit(0)).alias("bytes")).first()
    ranges = ranges or min(640, max(160, whole["n"] // 1_000_000))
    bounds = _quantiles(_sampled(narrow, ranges * per_range, whole["bytes"], 0), ranges)
    for turn in range(rounds):
        ranged = narrow.withColumn("_range", _range_of(bounds))
        totals = {r["_range"]: r for r in ranged.groupBy("_range").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes")).collect()}
        mean = max(1.0, whole["n"] / (len(bounds) + 1))
        mean_bytes = max(1.0, whole["bytes"] / (len(bounds) + 1))
        overfull = {k: r for k, r in totals.items() if (r["n"] > 3 * mean or r["bytes"] > 3 * mean_bytes) and r["n"] > 1000}
        if not overfull or turn == rounds - 1:
            break
        # subdivide: as many new boundaries as the range is too full, from a sample of its own rows
        inside = ranged.filter(F.col("_range").isin(*overfull))
        share = sum(r["bytes"] for r in overfull.values())
        pieces = {k: math.ceil(max(r["n"] / mean, r["bytes"] / mean_bytes)) for k, r in overfull.items()}
        new: dict[int, list] = {k: [] for k in overfull}
        for bound, w in _sampled(inside, per_range * sum(pieces.values()), share, turn + 1):
            new.setdefault(bisect_right(bounds, bound), []).append((bound, w))
        grown = sorted({*bounds, *(b for k, s in new.items() for b in _quantiles(s, pieces.get(k, 1)))})
        if len(grown) == len(bounds):
            break
        bounds = grown

    before_bytes, before_rows, b, n = [], [], 0, 0
    for k in range(len(bounds) + 1):
        before_bytes.append(b)
        before_rows.append(n)
        b, n = b + (totals[k]["bytes"] if k in totals else 0), n + (totals[k]["n"] if k in totals else 0)
    at = lambda values: F.element_at(F.lit(values).cast("array<bigint>"), F.col("_range") + 1)
    inside = Window.partitionBy("_range").orderBy("_key", "_oid", "_tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stored(
        ranged.withColumn("_end", F.sum("_size").over(upto) + at(before_bytes))
        .withColumn("_rank", F.row_number().over(inside) - 1 + at(before_rows))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * _end - _size) * {n_shards}) div {max(1, 2 * whole['bytes'])}")).cast("int"))
        .select("doc_id", F.col("_size").alias("size"), "text_crc32", "shard", "_rank"),
        "shards",
    )
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    starts = [sum(counts.get(s, 0) for s in range(k)) for k in range(n_shards)]
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_rank") - F.element_at(F.lit(starts).cast("array<bigint>"), F.col("shard") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
