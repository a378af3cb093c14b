"""Katz backoff against a model of Python dictionaries, and its probabilities against 1."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from fleetlens.llm import lm

SCHEMA = "doc_id long, text string, n long, level int, range int, score string"
SPACES = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w.translate(LOWER) for w in text.split(" ") if w] + [None]


class Katz:
    """The model as its formulas say, with dictionaries of tuples."""

    def __init__(self, docs, order):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        for tokens in docs:
            padded = ["<start>"] * (order - 1) + tokens
            for i in range(order - 1, len(padded)):
                for k in range(order):
                    self.counts[k][tuple(padded[i - k : i + 1])] += 1
        self.d = [lm.discounts([sum(c == r for c in n.values()) for r in range(1, lm.DISCOUNTED + 2)]) for n in self.counts]
        self.after = [defaultdict(dict) for _ in range(order)]
        for k in range(order):
            for g, c in self.counts[k].items():
                self.after[k][g[:-1]][g[-1]] = c
        self.memo = {}

    def kept(self, k, c):
        return c * (self.d[k][c] if c < len(self.d[k]) else 1.0)

    def context(self, k, h):
        if (k, h) not in self.memo:
            n = self.after[k][h]
            den = sum(n.values()) + (not any(c <= lm.DISCOUNTED for c in n.values()))
            left = 1 - sum(self.kept(k, c) for c in n.values()) / den
            lower = sum(self.p(k - 1, h[1:], w) for w in n) if k else 0.0
            self.memo[k, h] = den, left / (1 - lower)
        return self.memo[k, h]

    def p(self, k, h, w):
        if h not in self.after[k]:
            return self.p(k - 1, h[1:], w) if k else 1.0
        den, alpha = self.context(k, h)
        if w in self.after[k][h]:
            return self.kept(k, self.after[k][h][w]) / den
        return alpha * (self.p(k - 1, h[1:], w) if k else 1.0)

    def log(self, tokens):
        padded = ["<start>"] * (self.order - 1) + tokens
        return sum(math.log10(self.p(self.order - 1, tuple(padded[i - self.order + 1 : i]), padded[i])) for i in range(self.order - 1, len(padded)))


def texts(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "WORD", "word", "x" * 400, "中文"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out = ["".join(w + rng.choice(SPACES) for w in rng.choices(vocabulary, weights, k=rng.randint(1, 40))) for _ in range(n)]
    return out + [None, "", " \n", "only here", out[0], out[0], "same " * 400, "w1 " * 300 + "unseen words"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize(("order", "chunk", "per_range"), [(2, 300, 200), (2, 10**6, 10**6), (3, 500, 400), (1, 500, 400)])
def test_against_dictionaries(spark, order, chunk, per_range):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts(order))]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], SCHEMA).repartition(3)
    model = Katz([words(t or "") for i, t in rows if not held(i)], order)
    n, known = sum(model.counts[0].values()), model.counts[0]
    got = {r["doc_id"]: r for r in lm.katz_scores(docs, order, chunk=chunk, per_range=per_range).collect()}
    assert len(got) == len(rows) and any(r["held_out"] for r in got.values())
    for i, t in rows:
        r, w = got[i], words(t or "")
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum((x,) in known for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((known[(x,)] + 1) / (n + len(known) + 1)) for x in w), rel=1e-9)
        assert r["score"] == pytest.approx(model.log(w), rel=1e-9), t


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_add_up_to_one(order):
    """The model that the scores are equal to is normalised after every context, seen or not."""
    model = Katz([words(t or "") for t in texts(7)], order)
    vocabulary = [g[0] for g in model.counts[0]] + ["<unknown>"]
    for h in [*list(model.after[order - 1])[:40], ("never",) * (order - 1)]:
        assert sum(model.p(order - 1, h, w) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_discounts():
    assert list(lm.discounts([0, 0, 0, 0, 0, 0])) == [0, 0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9]
    d = lm.discounts([1000, 400, 200, 120, 80, 60])
    common = 6 * 60 / 1000
    assert d[1] == pytest.approx((2 * 400 / 1000 - common) / (1 - common)) and (d[1:] < 1).all() and (d[1:] > 0).all()


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(60) if held(i)][:4]
    got = lm.katz_scores(spark.createDataFrame([(i, "a b", 1, 2, 3, "x") for i in ids], SCHEMA)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 4
    assert lm.katz_scores(spark.createDataFrame([], SCHEMA)).collect() == []
