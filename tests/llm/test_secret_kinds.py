"""The network on kinds of tokens that its own examples do not make: keys of further issuers, and harmless ones."""

import random
import string

import numpy as np
import pytest

from fleetlens.llm import secrets

ALNUM = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def net(spark):
    return secrets.trained(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def kinds(rng, words):
    pick = lambda c, n: "".join(rng.choice(c) for _ in range(n))
    number = lambda a, b: str(rng.randint(a, b))
    keys = {
        "glpat": lambda: "glpat-" + pick(ALNUM + "-_", 20),
        "npm": lambda: "npm_" + pick(ALNUM, 36),
        "AIza": lambda: "AIza" + pick(ALNUM + "-_", 35),
        "storage account": lambda: pick(ALNUM + "+/", 86) + "==",
        "base32": lambda: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32),
        "lower case and digits": lambda: pick(string.ascii_lowercase + string.digits, rng.randint(20, 40)),
        "hf": lambda: "hf_" + pick(string.ascii_letters, 33) + "1",
        "pwd": lambda: "pwd: " + pick(ALNUM, rng.randint(9, 16)),
        "passphrase": lambda: "passphrase=" + pick(ALNUM + "._-", 14) + "7",
        "version and hex": lambda: "dop_v1_" + pick("0123456789abcdef", 31) + "g",
    }
    harmless = {
        "mixed plates": lambda: "-".join(pick(string.ascii_uppercase, 3) + pick(string.digits, 3) for _ in range(4)),
        "order": lambda: f"ORD-{number(2000, 2030)}-{number(10**5, 10**6)}-{pick(string.ascii_uppercase, 2)}-EU",
        "book number": lambda: f"978-{number(0, 9)}-{number(1000, 9999)}-{number(1000, 9999)}-{number(0, 9)}-rev2",
        "described commit": lambda: f"{rng.choice(words)}-{number(0, 9)}-{number(0, 20)}-{number(0, 9)}-{number(0, 99)}-g{pick('0123456789abcdef', 7)}",
        "image": lambda: "/".join(rng.choice(words) for _ in range(3)) + f"/img_{number(1000, 9999)}_large",
        "backup": lambda: f"backup-2020-{number(10, 12)}-{number(10, 28)}-{number(100000, 235959)}-full",
        "four-digit groups": lambda: "-".join(number(1000, 9999) for _ in range(5)) + "z",
        "two identifiers": lambda: "_".join("-".join(pick("0123456789abcdef", k) for k in (8, 4, 4)) for _ in range(2)),
        "camel case": lambda: "".join(rng.choice(words).capitalize() for _ in range(4)) + "V" + number(1, 9),
    }
    return keys, harmless


def test_kinds_that_are_not_made(net):
    rng = random.Random(99)
    words = ["".join(rng.choice("aeiou" if k % 2 else "bdlmnrst") for k in range(rng.randint(3, 9))) for _ in range(300)]
    rates = []
    for group in kinds(rng, words):
        of = {}
        for name, make in group.items():
            hits = 0
            for _ in range(60):
                text = f"{' '.join(rng.choice(words) for _ in range(12))} {make()} {' '.join(rng.choice(words) for _ in range(4))}"
                base = secrets.base_spans(text)
                found = secrets.candidates(text, base)
                hits += bool(base) or any(net.best([secrets.windows(text, s)])[0] >= net.threshold for s in found)
            of[name] = hits / 60
        rates.append(of)
    recall, wrong = (np.mean(list(of.values())) for of in rates)
    assert recall >= 0.9 and wrong <= 0.05, rates
    print("recall", recall, "false", wrong)


def test_documents_stand_on_one_side(spark, net):
    got = secrets.labelled_findings(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 300)
    held = secrets.split(got["text"].to_numpy())
    assert 0.1 < held.mean() < 0.6 and not set(got["text"][held]) & set(got["text"][~held])
    assert {0, 1} == set(got["y"][held]) == set(got["y"][~held]) and got["made"].any()


def test_copies_leave_something_to_learn_from(spark):
    rows = [(1, "one text of all rows")] * 5000 + [(2, "another text"), (3, "a third text")]
    got = secrets.labelled_findings(spark.createDataFrame(rows, "doc_id long, text string"), 400)
    assert 0 < len(got) <= 400 * 6 * 8
    assert secrets.trained(spark.createDataFrame([(1, "same")] * 50, "doc_id long, text string"), max_docs=20) is None
