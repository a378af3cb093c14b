"""Equal lines of any number of words go, in the operator's whole-job form and in the stage of the pipeline."""

import pytest

import corpus_pipeline
from fleetlens.llm import lines

ROWS = [
    (1, "All rights reserved.\n\none\na b c d e f g"),
    (2, "All  rights\treserved.\n\ntwo\none"),
    (3, "All rights reserved!\na b c d e f x\n"),
    (4, "one"),
    (5, None),
    (None, "two\nthree"),
]
# number of exact and alike lines, and what is left
WANT = {
    1: (0, 0, "All rights reserved.\n\none\na b c d e f g"),
    2: (2, 0, "\ntwo"),
    3: (0, 1, "All rights reserved!\n"),
    4: (1, 0, ""),
    5: (0, 0, None),
    None: (1, 0, "three"),
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")


def test_short_lines(rows):
    got = {r["doc_id"]: (r["n_exact"], r["n_near"], r["text"]) for r in lines.dedup_lines(rows).collect()}
    assert got == WANT


def test_short_lines_in_the_pipeline(spark, rows):
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, rows, "").collect()}
    assert got == {k: v[2] for k, v in WANT.items() if k != 4}


def test_short_lines_in_the_query(spark, rows, tmp_path):
    from fleetlens.llm.queries import op4_line_dedup

    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_exact"], r["n_near"]) for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: v[:2] for k, v in WANT.items()}
