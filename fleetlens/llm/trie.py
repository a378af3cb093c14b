"""Trie of conversation prefixes: every distinct sequence of first turns is a node, with sums over its subtree.

1. Conversations become arrays of turn ids (hashes of role and text), ranged by those arrays into shards, so that a node's
   members lie in one shard or in shards that follow each other.
2. Neighbouring shards compare their last and first conversation: only nodes on that common prefix lie in both.
3. In a shard, ids stand in padded matrices of a bounded number of columns, sorted by numpy's lexsort. Changes between
   rows, OR-accumulated over columns, mark where nodes start; reduceat over those starts sums members, children, leaves
   and tokens from the deepest column up. Rows that ended take no room in the matrices of later columns.
4. Nodes of several shards, at most two for a depth and shard, are added up by key, and each gives its own part to those above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import MIN_LONG, stored, word_count

#: Columns of one matrix, and turns in a shard.
WIDTH, PER_SHARD = 32, 100_000
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODES = "shard int, spans boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, path array<binary>, n_more long, words long, ends string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as structs of turn, id and words; a null role or text is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        # the least number pads rows
        F.struct("turn", F.greatest(F.xxhash64(role, text), F.lit(MIN_LONG + 1)).alias("id"), word_count(text).cast("int").alias("words")).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """conv_id, ids and words of each rebuilt conversation.

    Its first h turns are those of the conversation whose number is a multiple of `every`, its others its own after
    the first h; h is the checksum of its decimal number modulo `most`.
    """
    own = stored(turns_of(conversations), "turns")
    heads = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_heads"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "_base", "left").withColumn("_h", h)
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("_heads", none), F.lit(1), F.col("_h")), F.when(F.size("turns") > F.col("_h"), F.slice("turns", F.col("_h") + 1, F.size("turns"))).otherwise(none))
    return both.select("conv_id", turns.alias("_t")).select("conv_id", F.col("_t.id").alias("ids"), F.col("_t.words").alias("words"))


def _common(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def borders(sharded: DataFrame) -> DataFrame:
    """left and right of each shard: the common prefix with the shard before and after it; -1 where there is none."""
    row = F.struct("ids", "conv_id")
    edges = stored(sharded.groupBy("shard").agg(F.min(row)["ids"].alias("first"), F.max(row)["ids"].alias("last")), "edges")
    # one number for each shard is put in order
    order = edges.select("shard").withColumn("next", F.lead("shard").over(Window.orderBy("shard")))
    after = edges.select(F.col("shard").alias("next"), F.col("first").alias("_first"))
    met = stored(edges.join(order, "shard").join(after, "next", "left").select("shard", "next", F.when(F.col("next").isNotNull(), _common(F.col("last"), F.col("_first"))).alias("shared")), "borders")
    left = met.filter("next IS NOT NULL").select(F.col("next").alias("shard"), F.col("shared").alias("left"))
    return met.select("shard", F.coalesce("shared", F.lit(-1)).alias("right")).join(left, "shard", "left").select("shard", F.coalesce("left", F.lit(-1)).alias("left"), "right")


def _keys(ids: np.ndarray, depth: int) -> list[bytes]:
    """A name for each prefix of a sequence, from none to `depth` ids."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.copy().digest()]
    for x in ids[: max(depth, 0)]:
        h.update(int(x).to_bytes(8, "little", signed=True))
        out.append(h.copy().digest())
    return out


def _text(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


class _Shard:
    """The nodes of one shard's conversations."""

    def __init__(self, shard: int, conv: np.ndarray, ids: list[np.ndarray], words: list[np.ndarray], left: int, right: int) -> None:
        self.shard, self.conv, self.left, self.right = shard, conv, left, right
        self.size = np.array([len(x) for x in ids], np.int64)
        self.at = np.cumsum(self.size) - self.size
        none = np.zeros(0, np.int64)
        self.ids, self.words = (np.concatenate([none, *v]).astype(np.int64) for v in (ids, words))
        self.out: list[dict] = []

    def matrices(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For every WIDTH columns: the depth before them, rows in order, where nodes start, and where there are ids."""
        rows, group, out, depth = np.arange(len(self.conv)), np.zeros(len(self.conv), np.int64), [], 0
        while len(rows):
            more = self.size[rows] - depth
            columns = np.arange(min(WIDTH, max(int(more.max()), 1)))
            filled = columns < more[:, None]
            matrix = np.full(filled.shape, _LEAST)
            matrix[filled] = self.ids[((self.at[rows] + depth)[:, None] + columns)[filled]]
            order = np.lexsort((self.conv[rows], *matrix.T[::-1], group))
            rows, matrix, filled, group = rows[order], matrix[order], filled[order], group[order]
            change = np.ones(matrix.shape, bool)
            change[1:] = matrix[1:] != matrix[:-1]
            change[1:, 0] |= group[1:] != group[:-1]
            starts = np.logical_or.accumulate(change, axis=1) & filled
            out.append((depth, rows, starts, filled))
            if not depth:
                # rows that are equal so far are told apart by what follows
                whole = lambda r: (self._sequence(r).tolist(), self.conv[r])
                self.first = min(rows[(matrix == matrix[0]).all(axis=1)], key=whole)
                self.final = max(rows[(matrix == matrix[-1]).all(axis=1)], key=whole)
            keep = self.size[rows] > depth + WIDTH
            group, rows = np.cumsum(starts[:, -1])[keep], rows[keep]
            depth += WIDTH
        return out

    def nodes(self) -> pd.DataFrame:
        n = len(self.conv)
        matrices = self.matrices()
        heads, tails = _keys(self._sequence(self.first), self.left), _keys(self._sequence(self.final), self.right)
        leaves, saved, kids = (np.zeros(n, np.int64) for _ in range(3))
        place = np.zeros(n, np.int64)
        below: tuple[np.ndarray, dict] | None = None  # the nodes one deeper, and the rows where they start

        def level(depth: int, rows: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> None:
            nonlocal below
            total = lambda x: np.add.reduceat(np.where(inside, x, 0), starts)
            size, first = self.size[rows], rows[starts]
            members, more = total(1), total(size > depth)
            words = self.words[self.at[first] + depth - 1] if depth else np.zeros(len(starts), np.int64)
            spans = np.zeros(len(starts), bool)
            spans[0] |= depth <= self.left
            spans[-1] |= depth <= self.right
            n_children = total(kids[rows])
            kids[rows] = 0
            kids[first] = ~spans
            # a node that others have a part of gives its own share when it is put together
            saved[first] += np.where(spans, 0, (members - 1) * words)
            leaves[first] += np.where(spans, 0, more == 0)
            ended = np.flatnonzero(inside & (size == depth))
            lists = np.split(self.conv[rows[ended]], np.searchsorted(ended, starts[1:]))
            ends = [_text(x) for x in lists]
            least = np.minimum.reduceat(np.where(inside, self.conv[rows], _MOST), starts)
            key: list = [None] * len(starts)
            path: list = [None] * len(starts)
            for k, names, bound in ((0, heads, self.left), (len(starts) - 1, tails, self.right)):
                if depth <= bound:
                    key[k], path[k] = names[depth], names[: depth + 1]
            node = {
                "spans": spans, "depth": np.full(len(starts), depth), "conv_id": least, "n_convs": members, "n_children": n_children, "n_leaves": total(leaves[rows]), "saved_tokens": total(saved[rows]),
                "ends_sha256": [None if s else hashlib.sha256(e.encode()).hexdigest() for e, s in zip(ends, spans, strict=True)], "key": key, "path": path, "n_more": more, "words": words, "ends": [e if s and e else None for e, s in zip(ends, spans, strict=True)],
            }
            if below:
                place[rows] = np.arange(len(rows))
                up = np.searchsorted(starts, place[below[0]], "right") - 1
                below[1]["parent_conv_id"] = pd.Series(least[up], dtype="Int64").mask(spans[up])
                below[1]["parent_key"] = [key[k] for k in up]
            below = (first, node)
            self.out.append(node)

        for depth, rows, starts, filled in reversed(matrices):
            for d in reversed(range(starts.shape[1])):
                at = np.flatnonzero(starts[:, d])
                if len(at):
                    level(depth + d + 1, rows, at, filled[:, d])
        level(0, matrices[0][1], np.zeros(1, np.int64), np.ones(n, bool))
        self.out[-1] |= {"parent_conv_id": pd.array([None], "Int64"), "parent_key": [None]}
        return pd.concat([pd.DataFrame(x) for x in self.out], ignore_index=True).assign(shard=self.shard)

    def _sequence(self, row: int) -> np.ndarray:
        return self.ids[self.at[row] : self.at[row] + self.size[row]]


_COLUMNS = [x.split()[0] for x in _NODES.split(", ")]


def _nodes_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the conversations of one shard, whose size is bounded by the number of shards."""
    got = _Shard(int(pdf["shard"].iloc[0]), pdf["conv_id"].to_numpy(), list(pdf["ids"]), list(pdf["words"]), int(pdf["left"].iloc[0]), int(pdf["right"].iloc[0]))
    return got.nodes()[_COLUMNS]


def _hashed(parts: DataFrame) -> DataFrame:
    """key and ends_sha256 of lists that several shards have parts of; parts are read one after the other, never together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h = None, None
        for pdf in batches:
            done = []
            for k, text in zip(pdf["key"], pdf["ends"], strict=True):
                if k != key:
                    if h:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if h:
            yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "ends_sha256"])

    return parts.select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard").mapInPandas(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations of (conv_id, turn, role, text).

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. Turns go in
    order of turn, null first, equal ones by a hash of role and text; repeated rows are turns each. A null role or text is empty; rows without a conv_id
    belong to no conversation and are left out; texts of any length are one turn; an empty table has no node, not even a
    root; other columns are ignored. A conversation is one row of 12 bytes a turn.
    """
    built = stored(rebuilt(conversations), "conversations")
    total = built.agg(F.sum(F.size("ids")).alias("n"), F.count("*").alias("c")).first()
    shards = max(8, -(-((total["n"] or 0) + total["c"]) // per_shard))
    sharded = stored(built.repartitionByRange(shards, "ids", "conv_id").withColumn("shard", F.spark_partition_id()), "sharded")
    parts = stored(sharded.join(borders(sharded), "shard").groupBy("shard").applyInPandas(_nodes_of, _NODES), "nodes")
    inner, shared = parts.filter("NOT spans"), parts.filter("spans")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_more", "n_children", "n_leaves", "saved_tokens")]
    met = stored(shared.groupBy("key").agg(F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"), F.first("path").alias("path"), *sums), "shared-nodes")
    own = met.select(F.explode("path").alias("key"), ((F.col("n_convs") - 1) * F.col("words")).alias("_saved"), (F.col("n_more") == 0).cast("long").alias("_leaf"))
    own = own.groupBy("key").agg(F.sum("_saved").alias("_saved"), F.sum("_leaf").alias("_leaf"))
    kids = met.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_kids"))
    names = met.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    joined = met.join(own, "key").join(kids, "key", "left").join(names, "parent_key", "left").join(_hashed(shared.filter("ends IS NOT NULL")), "key", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_children") + F.coalesce("_kids", F.lit(0))).alias("n_children"), (F.col("n_leaves") + F.col("_leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    # the children of a node of several shards look it up in their own shard's part of it
    local = shared.select("shard", F.col("key").alias("parent_key")).join(names, "parent_key").withColumnRenamed("parent_conv_id", "_up")
    found = inner.join(local, ["shard", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    return found.select(*columns).unionByName(whole)
