"""keep_one and the pipeline's stage near decide by document, not by doc_id."""

import random

import corpus_pipeline
from fleetlens.llm import neardup


def made():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(80))
    a, b, c, d, e, f = (prose() for _ in range(6))
    near = lambda t: t + " tail"
    rows = [
        (1, a), (None, near(a)),  # a copy without id goes
        (None, b), (None, c), (None, d), (None, near(d)),  # clean ones without id stay, one of d's pair
        (7, near(a)), (7, e), (7, e),  # a repeated id: the copy goes, the clean text stays once
        (8, f), (9, f), (None, None), (10, None), (None, ""), (11, ""),
    ]
    kept = [(1, a), (None, b), (None, c), (7, e), (8, f), (None, None), (10, None), (None, ""), (11, "")]
    return rows, kept, {(None, d), (None, near(d))}


def check(got):
    _, kept, pair = made()
    either = [r for r in got if r in pair]
    assert len(either) == 1
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([r for r in got if r not in pair], key=key) == sorted(kept, key=key)


def test_keep_one(spark):
    df = spark.createDataFrame(made()[0], "doc_id long, text string").repartition(3)
    out = neardup.keep_one(df)
    assert out.columns == df.columns
    check([tuple(r) for r in out.collect()])


def test_stage_near(spark):
    df = spark.createDataFrame([(*r, "en", "s", None) for r in made()[0]], "doc_id long, text string, lang string, source string, n_chars long")
    check([(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, df, "").collect()])
