"""The trie of conversation prefixes against one made of Python dictionaries, and against the SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from fleetlens.llm import oracles, trie
from fleetlens.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth long, shard int, ids string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def rows_of(seed, n=120):
    """Conversations with few different turns, copies, missing bases, long ones, odd values and a number below zero."""
    rng, rows = random.Random(seed), []
    words = ["hi", "how are you", "fine  thanks\tfriend", None, "", "é à", "x " * 50]
    for c in rng.sample(range(-3, 3 * n), n):
        size = rng.choice([0, 1, 1, 2, 3, 5, 8, 40, 70]) + 1
        copied = random.Random(rng.randrange(6))
        source = copied if c % 2 else rng
        for k in range(size):
            rows.append((c, None if k == 0 and c % 7 == 0 else k, source.choice(["user", "bot", None]), source.choice(words), 1, 2, "x"))
    rows += [(None, 1, "user", "lost", 1, 2, "x")] * 2
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width"), [(1, 32), (2, 3), (3, 1)])
def test_against_dictionaries(spark, seed, width):
    rows = rows_of(seed)
    before, trie.WIDTH = trie.WIDTH, width
    try:
        pdf_rows = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), per_shard=300)
        got = sorted(tuple(r[c] if r[c] is not None else -(10**9) for c in COLUMNS) for r in pdf_rows.collect())
    finally:
        trie.WIDTH = before
    assert got == brute(rows)




def test_one_shard_gives_the_same_at_every_width():
    import numpy as np

    rng = random.Random(5)
    seqs = [np.array([rng.randrange(2) for _ in range(rng.choice([0, 1, 4, 9, 40]))], np.int64) for _ in range(200)]
    outs = []
    for width in (1, 2, 7, 32, 64):
        before, trie.WIDTH = trie.WIDTH, width
        made = trie._Shard(0, np.arange(200), seqs, [np.ones(len(x), np.int32) for x in seqs], 0, len(max(seqs, key=list))).nodes()
        trie.WIDTH = before
        outs.append(sorted(map(str, made[["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id", "spans"]].itertuples(index=False))))
    assert all(x == outs[0] for x in outs)


def test_many_copies_and_one_hot_first_turn(spark):
    rows = [(c, k, "user", f"t{k if c % 3 else 0}", 1, 2, "x") for c in range(900) for k in range(4)]
    got = sorted(tuple(r[c] if r[c] is not None else -(10**9) for c in COLUMNS) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), per_shard=100).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_gives_the_same(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(str, op12_prefix_trie(spark, sf).select(*COLUMNS).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert len(got) == len(want := c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracles.TRIE})").fetchall())
    assert [x.replace(".0", "") for x in got] == sorted(map(str, want))
