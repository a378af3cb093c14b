"""Alignment of two tokenizers against whole-text tokenization and all pairs of tokens."""

import hashlib
from collections import Counter

import pytest

from fleetlens.llm import alignment

SCHEMA = "doc_id long, text string, n long, best long, pair string, links int"
TEXTS = [None, "", " ", "a", "one two", "one two", "  lead  and   runs ", "tail\n\n  x\n y \t z", "a▁b", "<0x41> <s> <unk> <|endoftext|> [it's] they'll", "ﬁ ① é é \U0001f600\U0001f600", "word, word. Word;! x|#$%&* a.b,c", "\x00\x1c a\x1c b\x85 c  d　 e", "café straße, naïve 中文字 12345 67.8", "x" * 3000, "spam ham " * 2000, "a\r\nb\r\n c,\r", "der Hund, la révolution; ¿qué? ..."]


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by comparing every token with every other."""
    pair = alignment._Pair(*alignment.tokenizer_paths())
    docs = []
    for t in texts:
        a = pair.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        data = (" " + t).encode() if t else b""
        if b"".join(pair.a_bytes[i] for i in a) != data or b"".join(pair.b_bytes[i] for i in b) != data:
            a = b = []
        spans = []
        for ids, size in ((a, pair.a_size), (b, pair.b_size)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at + int(size[i])))
                at += int(size[i])
            spans.append(out)
        links, first = [], 0
        for i, s, e in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, since = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, x in side if since <= s < e) for side in spans))
            since = e
        docs.append((len(a), len(b), links, groups))
    counts = Counter(x for d in docs for x in d[2])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(a, b, len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, x, g in docs]


@pytest.fixture(scope="module")
def rows(spark):
    sf = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    return TEXTS + [t[:3000] for t in sf]


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 10])
def test_against_all_pairs(spark, rows, most_pairs):
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1, 2, "x", 3) for i, t in enumerate(rows)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in alignment.align(docs, most_pairs=most_pairs).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, w in enumerate(want):
        r = got[i if i != 3 else None]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == w, rows[i]
    assert got[0]["groups_sha256"] == got[8]["groups_sha256"] == "" and got[1]["n_links"] == 0


def test_batches_do_not_matter(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in enumerate(rows)], SCHEMA).coalesce(1)
    want = sorted(map(tuple, alignment.aligned(docs).drop("links").collect()))
    pair = alignment._Pair(*alignment.tokenizer_paths(), most=20)  # a cache that is emptied again and again
    for i, t in enumerate(rows):
        (a, b), = pair.ids([t])
        assert (len(a), len(b)) == want[i][1:3]


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).collect() == []
