"""The network of the secret scan is learned from every document, finding and window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import secrets
from fleetlens.llm.common import uniform

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    return [(i, " ".join(rng.choice(words) for _ in range(20)) + f" token = {''.join(rng.choice('abcdef12') for _ in range(20))}") for i in range(2060)]


def test_every_document_counts(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    last = docs.orderBy(uniform("doc_id", F.xxhash64("text"), seed=7).desc()).first()["doc_id"]  # beyond the 2,000 of least hash
    net, less = secrets.trained(docs.repartition(3)), secrets.trained(docs.filter(f"doc_id <> {last}"))
    assert any(not np.array_equal(net.weights[k], less.weights[k]) for k in net.weights)
    again = secrets.trained(docs.repartition(7))
    assert again.threshold == net.threshold and all(np.array_equal(net.weights[k], again.weights[k]) for k in net.weights)


def test_every_window_is_in_a_group_or_held_out(spark, rows, monkeypatch):
    rows = rows[:300] + [(5000, "secret=abcdefgh1 " * 9), (5001, "0123456789abcdef" * 100)] + [(6000 + i, rows[0][1]) for i in range(40)]
    docs, seen, held, train, calibrate = spark.createDataFrame(rows, DOCS), {}, set(), secrets._train_groups, secrets._calibrate_all

    def watch(net, found, seed):
        for r in found.select("x", "y", "g").collect():
            seen.setdefault(r["g"], []).append((bytes(r["x"]), r["y"]))
        train(net, found, seed)

    def watch_held(net, found, recall):
        held.update((bytes(r["x"]), r["y"]) for r in found.select("x", "y").collect())
        calibrate(net, found, recall)

    monkeypatch.setattr(secrets, "GROUP_DOCS", 20)
    monkeypatch.setattr(secrets, "_train_groups", watch)
    monkeypatch.setattr(secrets, "_calibrate_all", watch_held)
    assert secrets.trained(docs) is not None
    all_of = secrets.labelled_findings(docs, 10_000)
    is_held = secrets.split(all_of["text"].to_numpy())
    key = [(bytes(x), y) for x, y in zip(all_of["x"], all_of["y"], strict=True)]
    assert held == {k for k, h in zip(key, is_held, strict=True) if h}
    assert {k for g in seen.values() for k in g} == {k for k, h in zip(key, is_held, strict=True) if not h}
    assert len(seen) == 18 and max(map(len, seen.values())) < 3 * min(map(len, seen.values()))  # copies make no group large
    base = [(text, at, x) for text, at, x, m in zip(all_of["text"], all_of["at"], all_of["x"], all_of["made"], strict=True) if not m]
    assert len([1 for _, at, _ in base if at == 0]) >= 66  # all windows of the long one
    assert {17 * k for k in range(9)} <= {at for _, at, _ in base}  # all nine of one document


def test_counted_calibration_is_that_of_single_findings():
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < 0.4).astype(float)
    x = rng.integers(1, secrets.ALPHABET, (4000, secrets.WIDTH)).astype(np.uint8)
    one, two = secrets.CharNet(), secrets.CharNet()
    one.calibrate(x, y, 0.9)
    z, n = np.unique(np.stack([one.logits(x), y]), axis=1, return_counts=True)
    two.calibrate_counted(z[0], z[1], n.astype(float), 0.9)
    assert len(n) < 4000 and np.allclose(one.scale, two.scale) and one.threshold == two.threshold
    true = np.sort(one.scores(x[y > 0]))
    assert one.threshold == true[int((1 - 0.9) * len(true))]
