"""Repeated passages: documents are read twice at most, and looked at in blocks that change no piece."""

import hashlib
import random

import numpy as np

from fleetlens.llm import substrings


def made(seed=5, n=90):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, texts = prose(45), [None, "", "short", "x" * 900, "é" * 60]
    for _ in range(n):
        p = passage.split()
        p[rng.randrange(len(p))] = rng.choice(words)
        texts.append(rng.choice([prose(rng.randint(0, 80)), f"{prose(9)} {' '.join(p)} {prose(rng.randint(0, 9))}", passage, texts[-1]]))
    return list(enumerate(texts))


def plain_removal(rows, length=100):
    seen, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_documents_are_read_twice_only(spark):
    """Once for their anchors, once to be stored; the anchors' one shuffle serves both their count and their rows."""
    rows, read = made(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    assert substrings.remove_repeats(docs).count() == len(rows)
    assert read.value == 2 * len(rows)


def test_small_batches_change_nothing(spark):
    """Rows of one anchor that lie in several batches, and texts of which each is a batch."""
    rows, key = made(6), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in (1, 3, 10_000):
            spark.conf.set(key, size)
            got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group_rows=40).collect()
            assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == plain_removal(rows)
    finally:
        spark.conf.set(key, before)


def test_pieces_in_blocks(monkeypatch):
    data = [(t or "").encode() for _, t in made(7)] + [b"", b"a" * 99, b"b" * 100, b"ab" * 2000]
    ends = np.cumsum([0] + [len(d) for d in data])
    alone = [substrings.pieces_of(d) for d in data]
    for block in (64, 500, 1 << 16):
        monkeypatch.setattr(substrings, "BLOCK", block)
        row, *columns = substrings.pieces_in(np.frombuffer(b"".join(data), np.uint8), ends)
        assert row.tolist() == [i for i, p in enumerate(alone) for _ in p[0]]
        for k, column in enumerate(columns):
            assert column.tolist() == np.concatenate([p[k] for p in alone]).tolist()
