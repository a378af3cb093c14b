"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text's shingle set is sketched once (set digest, minimum hashes, band keys). Equal sets become one node.
2. Nodes that share a band key are candidates. A bucket is not expanded into pairs: its members are compared with one
   leader, the member whose other buckets are largest (the middle of a group of copies).
3. A pair's signatures are compared in batches; a pair goes as soon as the posterior probability that its similarity
   reaches the threshold falls under the chosen miss probability. Survivors are verified on full shingle sets.
4. Components of the verified links. A bucket that still holds more than one component may have links between two
   members that are both unlike the leader. For the members of such buckets the shingles that no other one has are
   found: two sets with x and y shared shingles have at most min(x, y) in common, so a member with many shingles of its
   own, as an outlier in a group of copies has, is ruled out against all members at once, and exactly. What is left is
   compared in blocks that are dealt out over tasks: by that bound, by the signatures, and by a second exact bound, for
   which each set's shared shingles are counted by hash in a few hundred cells (two sets have at most the sum of the
   cells' minima in common). Of the pairs that remain first only the likeliest that would join components (a spanning
   forest of each block) are verified, and components are built again; at the end every pair left between components
   is. The forests are linear in a bucket's members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import join_counted, join_wide, private, stored
from fleetlens.llm.components import components
from fleetlens.llm.shingles import band_keys, minhashes, set_digest, shingle_set

HASHES, ROWS, BATCH, BLOCK = 128, 4, 16, 256
_TOP = 2**63 - 1


def least_matches(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest agreeing hashes with which a pair stays.

    With a uniform prior, similarity after m of n agreements is Beta(m + 1, n - m + 1), and its mass above the threshold
    is the chance of at most m successes in n + 1 trials at the threshold.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, needed: list[int], batch: int = BATCH) -> np.ndarray:
    """Indices of the signature pairs (rows of a and b) that no batch prunes."""
    alive, agree = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(needed):
        part = slice(k * batch, (k + 1) * batch)
        agree[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[agree[alive] >= least]
    return alive


def cells_of(hashes: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall in each of 128 to 1024 cells, more for larger sets."""
    g = min(1024, max(128, 1 << (max(1, len(hashes)) - 1).bit_length()))
    return np.minimum(np.bincount((hashes & (g - 1)).astype(np.int64), minlength=g), 65_535).astype(np.uint16)


class _Cells:
    """The cells of many sets, folded to any number that two of them share."""

    def __init__(self, column: pd.Series) -> None:
        # a cell that could not count further bounds nothing: it stands for 2**24
        self.own = [np.where(x < 65_535, x.astype(np.int32), 2**24).astype(np.int32) for x in (np.frombuffer(x, np.uint16) for x in column)]
        self.size = np.array([len(x) for x in self.own])
        self.folded = {int(g): np.stack([x.reshape(-1, g).sum(axis=0, dtype=np.int32) if len(x) >= g else np.zeros(g, np.int32) for x in self.own]) for g in np.unique(self.size)}

    def most_common(self, x: int, y: np.ndarray) -> np.ndarray:
        """At most how many elements set x has in common with each of the sets y."""
        out, g = np.zeros(len(y), np.int64), np.minimum(self.size[x], self.size[y])
        for level in np.unique(g):
            at, rows = g == level, self.folded[int(level)]
            out[at] = np.minimum(rows[x], rows[y[at]]).sum(axis=1)
        return out


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, HASHES)


def _grouped(docs: DataFrame, percent: int = 75, words: int = 5, miss: float = 1e-6) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, root (a number for each component; null for texts
    without words) and mark, a hash of the text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 2000):
                part, out = pdf.iloc[k : k + 2000], []
                for text in part["text"]:
                    s = shingle_set(text, words)
                    if len(s):
                        signature = minhashes(s, HASHES)
                        out.append((len(s), set_digest(s), signature.tobytes(), band_keys(signature, ROWS)))
                    else:
                        out.append((0, None, None, None))
                n, digest, signature, keys = zip(*out, strict=True)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "mark": part["mark"].array, "n_shingles": n, "digest": digest, "signature": signature, "bands": keys})

    sketch = stored(plain.mapInPandas(sketched, "doc_id long, mark long, n_shingles long, digest binary, signature binary, bands array<bigint>").withColumn("row", F.monotonically_increasing_id()), "sketches")
    # a node for each distinct set: the row that stands for it, and the least doc_id
    classes = stored(sketch.filter("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("node"), F.coalesce(F.min("doc_id"), F.lit(_TOP)).alias("label"), F.count("*").alias("n")), "set-classes")
    nodes = stored(sketch.filter("n_shingles > 0").select("row", "doc_id", "mark", "n_shingles", "signature", "bands").join(classes.select(F.col("node").alias("row"), "label", "digest"), "row").withColumnRenamed("row", "node"), "set-nodes")
    bands = nodes.select("node", F.explode("bands").alias("key"))
    counts = stored(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = stored(join_counted(bands, counts, ["key"]), "bucket-members")
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    leaders = stored(members.join(score, "node").groupBy("key").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("leader"), F.first("n").alias("n")), "bucket-leaders")
    pairs = stored(join_counted(members.select("key", "node"), leaders, ["key"]).filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "leader-pairs")

    needed = least_matches(percent / 100, miss)
    sides = nodes.select("node", "n_shingles", "signature")
    side = lambda x: sides.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"

    def pruned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.iloc[surviving(_signatures(pdf["s_a"]), _signatures(pdf["s_b"]), needed)][["a", "b"]]

    first = stored(join_wide(pairs, side("a"), "a", "b").join(side("b"), "b").filter(fits).select("a", "b", "s_a", "s_b").mapInPandas(pruned, "a long, b long"), "pruned-pairs")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """node and its full set of shingle hashes, for the nodes in wanted; texts are read again."""
        wanted = wanted.distinct().join(nodes.select("node", F.col("doc_id").alias("id"), F.col("mark").alias("id_mark"), "digest"), "node")

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for node, digest, text in zip(pdf["node"], pdf["digest"], pdf["text"], strict=True):
                    s = shingle_set(text, words)
                    if set_digest(s) == digest:  # another text may have the same hash
                        out.append((node, s.view(np.int64)))
                yield pd.DataFrame(out, columns=["node", "hashes"])

        read = plain.join(wanted, plain["doc_id"].eqNullSafe(wanted["id"]) & (plain["mark"] == wanted["id_mark"])).select("node", "digest", "text")
        # rows that are equal in doc_id and text give one set
        return read.mapInPandas(sets, "node long, hashes array<bigint>").groupBy("node").agg(F.first("hashes").alias("hashes"))

    def verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs of nodes whose full sets are similar enough."""

        def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                keep = []
                for x, y in zip(pdf["h_a"], pdf["h_b"], strict=True):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pdf.loc[np.array(keep, bool), ["a", "b"]]

        sided = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h_{x}"))
        with_a = join_wide(candidates, sided("a"), "a", "b")
        return stored(with_a.join(sided("b"), "b").select("a", "b", "h_a", "h_b").mapInPandas(similar, "a long, b long"), "verified-pairs")

    links, tested = verified(first, sets_of(first.select(F.col("a").alias("node")).union(first.select("b")))), first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = components(links)

    # members of the buckets that hold more than one component
    placed = stored(members.filter("n > 2").select("key", "node").join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")), "bucket-roots")
    unlike = lambda df, *more: df.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y"), *more).filter("x <> y").drop("x", "y")
    held = stored(join_counted(placed, stored(unlike(placed), "open-buckets"), ["key"]).select("key", "node"), "open-members")
    sets = stored(sets_of(held.select("node")), "open-sets")
    # shingles that another set has as well are the most that a set can have in common with any
    lone = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.first("node").alias("node")).filter("n = 1").groupBy("node").agg(F.collect_list("h").alias("lone"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shared = [x if y is None else np.setdiff1d(x, y, assume_unique=True) for x, y in zip(pdf["hashes"], pdf["lone"], strict=True)]
            yield pd.DataFrame({"node": pdf["node"], "n_shingles": [len(x) for x in pdf["hashes"]], "common": [len(x) for x in shared], "cells": [cells_of(x).tobytes() for x in shared]})

    facts = stored(sets.join(lone, "node", "left").select("node", "hashes", "lone").mapInPandas(counted, "node long, n_shingles long, common long, cells binary"), "open-facts")
    known = stored(held.join(facts.drop("cells"), "node"), "open-known")
    least = stored(known.groupBy("key").agg(F.count("*").alias("n"), F.min("n_shingles").alias("least")), "open-least")
    # with `common` shared shingles, a partner has at most this many altogether
    reach = F.floor(F.col("common") * (100 + percent) / percent) - F.col("n_shingles")
    live = stored(join_counted(known, least, ["key"]).filter((reach >= F.col("least")) & (100 * F.col("common") >= percent * F.col("n_shingles"))).select("key", "node", "n_shingles", "common"), "live-members")

    def left_over(roots: DataFrame, forest: bool) -> DataFrame:
        """Pairs of different components in a bucket that neither the bounds nor the signatures rule out.

        With forest only pairs inside blocks, and only the likeliest that join; every member is dealt to a block twice,
        independently, so that what is alike in different blocks of one dealing meets in the other.
        """
        placed = stored(live.join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")), "live-roots")
        rest = join_counted(placed, stored(unlike(placed), "live-buckets"), ["key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("deal", F.explode(F.lit([0, 1] if forest else [0]))).filter("deal = 0 OR blocks > 1").withColumn("own", F.pmod(F.xxhash64("node", "deal"), F.col("blocks")).cast("int")).join(sides.select("node", "signature"), "node").join(facts.select("node", "cells"), "node")
        # a member meets every block, its own as well: rows of (key, lower block, higher block)
        met = rest.withColumn("other", F.col("own")) if forest else rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = met.select("key", "deal", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "n_shingles", "common", "signature", "cells")

        def compared(pdf: pd.DataFrame) -> pd.DataFrame:
            key, i, j = pdf["key"].iloc[0], pdf["i"].iloc[0], pdf["j"].iloc[0]
            pdf = pdf.sort_values("node")
            s, cells = _signatures(pdf["signature"]), _Cells(pdf["cells"])
            node, root, size, most, own = (pdf[c].to_numpy() for c in ("node", "root", "n_shingles", "common", "own"))
            left, right, found = np.flatnonzero(own == i), np.flatnonzero(own == j), []
            for x in left:
                both = np.minimum(most[right], most[x])
                y = right[(root[right] != root[x]) & (100 * both >= percent * (size[right] + size[x] - both))]
                if i == j:
                    y = y[y > x]
                if len(y):
                    y = y[surviving(np.broadcast_to(s[x], (len(y), HASHES)), s[y], needed)]
                    both = cells.most_common(x, y)
                    y = y[100 * both >= percent * (size[y] + size[x] - both)]
                    if not forest:  # a pair is given by the first of the buckets that it shares
                        first_band = (s[y] == s[x]).reshape(len(y), HASHES // ROWS, ROWS).all(axis=2).argmax(axis=1)
                        y = y[band_keys(s[x], ROWS)[first_band] == key]
                    found += [(int((s[x] == s[k]).sum()), x, k) for k in y]
            if forest:
                found = _forest(found, root)
            return pd.DataFrame([(min(node[x], node[k]), max(node[x], node[k])) for _, x, k in found], columns=["a", "b"]).astype("int64")

        return dealt.groupBy("key", "deal", "i", "j").applyInPandas(compared, "a long, b long").distinct()

    for forest in (True, False):
        more = stored(left_over(roots, forest).join(tested, ["a", "b"], "left_anti"), "more-pairs")
        if more.isEmpty():
            continue
        tested, new = tested.union(more), verified(more, sets)
        if not new.isEmpty():
            links = links.union(new)
            roots = components(links)
    # a component's least doc_id, given to its sets and by them to its rows
    placed = stored(classes.join(roots.withColumnRenamed("v", "node"), "node", "left").select("digest", "label", F.col("n").alias("rows"), F.coalesce("root", "node").alias("root")), "set-roots")
    least = stored(placed.groupBy("root").agg(F.count("*").alias("n"), F.min("label").alias("least")), "component-labels")
    named = stored(join_counted(placed, least, ["root"]).select("digest", "root", F.nullif("least", F.lit(_TOP)).alias("component"), F.col("rows").alias("n")), "set-components")
    rows = sketch.select("doc_id", "mark", "n_shingles", "digest")
    found = join_counted(rows.filter("n_shingles > 0"), named, ["digest"]).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "root", "mark")
    return found.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"), "mark"))


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = 5, miss: float = 1e-6) -> DataFrame:
    """Groups rows of docs (doc_id, text) whose shingle sets have Jaccard similarity of at least percent / 100.

    Returns doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id), one row
    per input row. Texts that are null or without words have an empty set and are linked with nothing; texts with fewer
    than `words` words are one shingle; repeated rows and ties share a component; a null doc_id takes the component's
    least id if there is one; an empty table gives no rows; other columns are ignored.
    Band keys miss a pair of similarity 0.75 with chance 5e-6, the Bayesian rule with at most 8 * miss.
    """
    found = _grouped(docs, percent, words, miss)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _forest(found: list[tuple[int, int, int]], root: np.ndarray) -> list[tuple[int, int, int]]:
    """Of the pairs (agreements, x, y), most agreements first, those that join components not joined by earlier ones."""
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while parent.setdefault(r, r) != r:
            parent[r] = r = parent[parent[r]]
        return r

    out = []
    for n, x, y in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        a, b = top(root[x]), top(root[y])
        if a != b:
            parent[a] = b
            out.append((n, x, y))
    return out


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """docs with one row of each component of near_duplicates; columns unchanged.

    A document is a pair of doc_id and text. The one of least doc_id stays (null last, ties by a hash of the text), so a
    null or repeated id takes no other document along: of several documents with one id, each stays or goes by its own
    component. Texts without words are linked with nothing and stay. Rows equal in doc_id and text stay once.
    """
    doc, mark = private("doc"), private("mark")
    rows = _grouped(docs.select("doc_id", "text"), **how)
    alone = lambda c: F.when(F.col("root").isNull(), F.col(c)).alias(f"alone_{c}")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("x")
    ids = rows.groupBy("root", alone("doc_id"), alone("mark")).agg(first).select(F.col("x.doc_id").alias(doc), F.col("x.mark").alias(mark))
    kept = docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(mark)), "left_semi")
    return kept.withColumn(mark, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", mark]).drop(mark)
