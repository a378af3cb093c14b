"""run() against a plain version of its stages; odd, empty and repeated rows; columns named like helper columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from fleetlens.llm import common, lines, mixing, neardup, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    """Prose of many lines with copies, near copies, shared lines, junk, and rows that are missing something."""
    rng = random.Random(41)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    notice, rows = "all rights are reserved by those who wrote this text", []
    for i in range(120):
        body = [prose(rng.randint(12, 30)) for _ in range(rng.randint(4, 8))]
        if i % 4 == 0:
            body.insert(2, notice if i % 8 else notice.replace("wrote", "typed"))
        if i % 5 == 0:
            body.append("The end.")
        rows.append((i, "\n".join(body)))
    for i in range(120, 140):  # copies: exact ones, and with a word exchanged in every third line
        body = rows[i - 100][1].split("\n")
        if i % 2:
            body = [" ".join([*x.split()[:-1], "changed"]) if k % 3 == 0 else x for k, x in enumerate(body)]
        rows.append((i, "\n".join(body)))
    for i in range(140, 150):  # one line each: copies that line dedup finds not
        x = rows[100 + i % 5][1].replace("\n", " ").split()
        x[10:12], x[30:32] = ["other", "words"], ["again", "others"]
        rows.append((i, " ".join(x)))
    rows += [(i, (prose(2) + " ") * 60) for i in range(150, 155)]  # fails the base rule
    rows += [(i, " ".join(w.upper() + "!!" for w in prose(80).split())) for i in range(155, 185)]  # labelled junk
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "few words"), (204, rows[3][1]), (204, rows[3][1]), (None, prose(70)), (None, prose(75)), (205, prose(9000))]
    return [(i, t, "en", ["a", "b", None, "C"][(i or 7) % 4], None if t is None else len(t)) for i, t in rows]


def repeats(text):
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})


def alike(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_lines(rows):
    """(doc_id, text) without lines that have an earlier equal or alike one; rows equal in both are one document."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    before, gone = [], defaultdict(set)
    for r in order:
        for k, x in enumerate((r[1] or "").split("\n")):
            w = WORD.findall(x)
            if w and any(w == b or (min(len(w), len(b)) >= 6 and abs(len(w) - len(b)) < 2 and alike(w, b)) for b in before):
                gone[r].add(k)
            if w:
                before.append(w)
    out = []
    for r in rows:
        left = "\n".join(x for k, x in enumerate((r[1] or "").split("\n")) if k not in gone[r])
        if not (gone[r] and not left.strip(" \t\n\x0b\f\r")):
            out.append((r[0], left))
    return out


def plain_near(rows):
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for _, t in docs:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return [d for i, d in enumerate(docs) if root[i] == i]


def test_run_against_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = made()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(120)] + [(i, 0, 0) for i in range(155, 185)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # rows whose base statistics fail, and the junk that is labelled, go; all clean ones stay
    good = [(i, t) for i, t, *_ in rows if t and len(WORD.findall(t)) >= 50 and 100 * repeats(t) <= 50 * len(WORD.findall(t)) and not 155 <= (i or 0) < 185]
    want = plain_near(plain_lines(good))
    folder = Path(common.shared_dir(spark)) / "fleetlens"
    before = set(folder.glob("*"))
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    source = {i: s for i, _, _, s, _ in rows}
    # of what the stages wrote, their results alone are left, and what the last one still reads
    assert {x.name.rsplit("-", 1)[0] for x in set(folder.glob("*")) - before} == {"stage-quality", "stage-lines", "stage-near", "stage-mix", "pieces"}
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    size, taken = Counter(), Counter()
    texts = defaultdict(list)
    for i, t in want:
        texts[i].append(t)
        size[source[i]] += len(WORD.findall(t))
    assert set(pieces) <= set(texts)
    for i, ts in texts.items():
        found = Counter((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces[i])
        for t in ts:
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
            own = [(a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
            copies = {found.pop(x, 0) for x in own}
            assert len(copies) == 1 and max(copies) <= 3
            taken[source[i]] += max(copies) * len(WORD.findall(t))
        assert not +found
    names = sorted((s for s in size if s is not None), key=str.encode) + [None] * (None in size)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, free, total = {}, set(names), sum(size.values())
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    assert all(abs(taken[s] - target[s]) <= 0.2 * target[s] + 200 for s in size)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(5, "", None, None, None), (None, "one two", "en", "s", 7)]])
def test_run_on_empty_and_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # none has enough words
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert name == "packing" or got.columns == docs.columns
        assert got.count() <= docs.count()


def test_columns_named_like_helpers_pass_through(spark):
    names = ["_id", "_m", "_mark", "_body", "_words", "_lines", "_windows", "_placed", "_at", "_copies", "_n", "_exact", "_near", "root", "n", "h", "key", "node"]
    rng = random.Random(43)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    text = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(8))
    rows = [(i, text(), "s", *[f"{c}{i}" for c in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    for out in (quality.judged(docs, []), lines.dedup_lines(docs), neardup.keep_one(docs), mixing.take(docs)):
        got = out.collect()
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)
