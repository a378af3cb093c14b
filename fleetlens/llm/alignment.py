"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often ids meet corpus-wide.

A is a byte-level BPE over a space and the text, B a sentence-piece BPE that adds that space itself. Tokens of both tile
the same bytes. Per batch of documents `pandas.merge_asof`, keyed by document, finds for each token's start the covering
token of the other side; the union of both directions is every overlapping pair (whichever of two overlapping tokens
starts later starts inside the other), and ends that both sides have cut a document into groups.

Counts of id pairs are made from the stored links. They are sent to the scoring tasks when there are at most
`most_pairs` of them, else they are joined to each document's pairs, without a frequent pair meeting in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import join_counted, stored
from fleetlens.llm.packing import _byte_letters

#: Tokens of one side that are looked at together; a longer document is looked at alone.
TOGETHER = 300_000
#: Pairs of ids of which the counts are sent to every task: 17 bytes each.
MOST_PAIRS = 4_000_000

# Marks behind a word that may be parted from it, and the letter that stands for a space in pieces.
_MARKS = ".,;:!?|#$%&*"
_SPACE = "▁"
# Fixed value: up to this letter the pattern of A and Python agree on what a letter is, whatever their versions.
_LATIN = "\u024f"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
#: A space, not the last character, behind what no tokenizer takes for white space: neither joins tokens across it.
_BREAK = re.compile(r"(?<=\S) (?!\Z)")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class _Pair:
    """Both tokenizers, with the ids of every chunk of text between breaks that was met so far.

    A chunk is what lies between two breaks, without the space before it. Words are parted from marks behind them, since
    A always parts letters from marks and B has no piece of a letter and one of these marks.
    """

    def __init__(self, a_path: str, b_path: str, most: int = 500_000) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.most = most
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {letter: byte for byte, letter in enumerate(_byte_letters())}
        n_a = self.a.get_vocab_size()
        names = [self.a.id_to_token(i) or "" for i in range(n_a)]
        self.a_bytes = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.match(p)) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        joins = {(x, y) for p in plain for x, y in zip(p, p[1:], strict=False)}
        self.breaks = not any(y == _SPACE != x for x, y in joins)
        self.marks = "".join(m for m in _MARKS if self.breaks and not any(y == m and x.isalpha() for x, y in joins))
        # what stands behind an id in a document's text of groups, by id and kind of end
        self.ends = [f"{i}{e}" for size, ends in ((n_a, ",|"), (len(pieces), ",;")) for e in ends for i in range(size)]
        self.tokenize, self.letters = self.a.model.tokenize, _byte_letters()
        #: Ids (little-endian 32-bit) by chunk, and the chunks whose bytes one side does not give back.
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.tails: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.bad: set[str] = set()

    def _a_ids(self, chunks: list[str]) -> list[list[int]]:
        """A's ids of each chunk after a space. Latin words go to its merges at once: they are one piece of its pattern."""
        rest = [k for k, c in enumerate(chunks) if not (c.isalpha() and max(c) <= _LATIN)]
        tokenize, letters, out = self.tokenize, self.letters, [None] * len(chunks)
        for k, x in zip(rest, self.a.encode_batch_fast([" " + chunks[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = x.ids
        space = letters[32]
        for k, c in enumerate(chunks):
            if out[k] is None:
                out[k] = [t.id for t in tokenize(space + (c if c.isascii() else c.encode().decode("latin-1").translate(letters)))]
        return out

    def _learned(self, chunks: list[str], into: tuple[dict[str, bytes], dict[str, bytes]], shift: str = "") -> None:
        """Ids of chunks after a space and `shift`, whose own ids are left out."""
        if shift:
            a = [x.ids for x in self.a.encode_batch_fast([" " + shift + c for c in chunks], add_special_tokens=False)]
            b = self.b.encode([shift + c for c in chunks], num_threads=1)
            cut_a, cut_b = len(self.a.encode(" " + shift, add_special_tokens=False).ids), len(self.b.encode(shift))
            a, b = [x[cut_a:] for x in a], [x[cut_b:] for x in b]
        else:
            a, b = self._a_ids(chunks), self.b.encode(chunks, num_threads=1)
        want = [(c if shift else " " + c).encode() for c in chunks]
        ends = np.cumsum([len(x) for x in want])
        same = np.ones(len(chunks), bool)
        for ids, names, size, out in ((a, self.a_bytes, self.a_size, into[0]), (b, self.b_bytes, self.b_size, into[1])):
            upto = np.cumsum([len(x) for x in ids])
            flat = np.fromiter(chain.from_iterable(ids), "<u4", upto[-1])
            data = flat.tobytes()
            out.update(zip(chunks, [data[4 * i : 4 * j] for i, j in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)], strict=True))
            placed = np.concatenate([[0], np.cumsum(size[flat])])[upto]
            if not (np.array_equal(placed, ends) and b"".join(map(names.__getitem__, flat.tolist())) == b"".join(want)):
                same &= [b"".join([names[i] for i in x]) == w for x, w in zip(ids, want, strict=True)]
        self.bad.update(c for c, ok in zip(chunks, same, strict=True) if not ok)

    def learn(self, chunks: set[str]) -> None:
        known = self.known[0]
        new = [c for c in chunks if c not in known]
        if len(known) + len(new) > self.most:
            for d in (*self.known, *self.words):
                d.clear()
            self.bad &= set(self.tails[0])
            new = list(chunks)
        parted, whole = {}, []
        for c in new:
            word = c.rstrip(self.marks) if self.marks else c
            if word != c and word.isalpha():
                parted[c] = (word, c[len(word) :])
            else:
                whole.append(c)
        todo = ((sorted({w for w, _ in parted.values()}.difference(self.words[0], known)), self.words, ""), (sorted({m for _, m in parted.values()}.difference(self.tails[0])), self.tails, "a"), (whole, self.known, ""))
        for wanted, into, shift in todo:
            for k in range(0, len(wanted), 10_000):
                self._learned(wanted[k : k + 10_000], into, shift)
        for side in (0, 1):
            words, marks, out = self.words[side], self.tails[side], self.known[side]
            out.update([(c, (words[w] if w in words else out[w]) + marks[m]) for c, (w, m) in parted.items()])
        if self.bad:
            self.bad.update(c for c, (w, m) in parted.items() if w in self.bad or (m in self.bad))

    def ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B for each text; both are empty where bytes differ, and for no text."""
        if self.breaks:
            split = [t.split(" ") if t else [] for t in texts]
            chunks = set().union(*split)
            # an empty part or white space before a space: the spaces that are no breaks stay
            if odd := {p for p in chunks if not p or p[-1].isspace()}:
                split = [parts if odd.isdisjoint(parts) else _BREAK.split(t) if t else [] for t, parts in zip(texts, split, strict=True)]
                chunks = set().union(*split)
        else:
            split = [[t] if t else [] for t in texts]
            chunks = {t for t in texts if t}
        self.learn(chunks)
        a, b = (d.__getitem__ for d in self.known)
        none = np.zeros(0, np.int64)
        out = []
        for parts in split:
            if not parts or not self.bad.isdisjoint(parts):
                out.append((none, none))
            else:
                out.append(tuple(np.frombuffer(b"".join(map(get, parts)), "<u4").astype(np.int64) for get in (a, b)))
        return out


@lru_cache(maxsize=2)
def _pair_of(a_path: str, b_path: str) -> _Pair:
    return _Pair(a_path, b_path)


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of all overlapping tokens; starts are places in a batch and rise, both sides tile the same bytes."""
    a, b = pd.DataFrame({"at": start_a, "doc": doc_a}), pd.DataFrame({"at": start_b, "doc": doc_b})
    cover_b = pd.merge_asof(a, b.assign(j=np.arange(len(b))), on="at", by="doc")["j"].to_numpy()
    cover_a = pd.merge_asof(b, a.assign(i=np.arange(len(a))), on="at", by="doc")["i"].to_numpy()
    # tokens that start together are found from both sides; they are taken once
    late = np.flatnonzero(start_a[cover_a] != start_b)
    return np.concatenate([np.arange(len(a)), cover_a[late]]), np.concatenate([cover_b, late])


def _align(pair: _Pair, ids: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """n_a, n_b, n_groups, n_links, groups_sha256 and links (pairs of ids as numbers, in order of A) of each document."""
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *[x[k] for x in ids]]) for k in (0, 1))
    doc_a, doc_b = np.repeat(np.arange(len(ids)), n_a), np.repeat(np.arange(len(ids)), n_b)
    end_a, end_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    i, j = overlaps(doc_a, end_a - pair.a_size[a], doc_b, end_b - pair.b_size[b])
    links = a[i] * len(pair.b_bytes) + b[j]
    at = doc_a[i]
    order = np.argsort(at, kind="stable")
    links = links[order].astype(np.int32 if len(pair.a_bytes) * len(pair.b_bytes) < 2**31 else np.int64)
    n_links = np.bincount(at, minlength=len(ids))
    # ends that both sides have
    both_a, both_b = (np.searchsorted(y, x) for x, y in ((end_a, end_b), (end_b, end_a)))
    last_a, last_b = end_b[np.minimum(both_a, len(end_b) - 1)] == end_a if len(a) else none == 1, end_a[np.minimum(both_b, len(end_a) - 1)] == end_b if len(b) else none == 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n_groups = np.bincount(doc_a[last_a], minlength=len(ids))
    # each id with the mark behind it, in the order of the text: a group's A, then its B
    per_a, per_b = np.bincount(group_a), np.bincount(group_b)
    text = np.empty(len(a) + len(b), np.int64)
    text[np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]] = a + last_a * len(pair.a_bytes)
    text[np.arange(len(b)) + np.cumsum(per_a)[group_b]] = 2 * len(pair.a_bytes) + b + last_b * len(pair.b_bytes)
    cut_text, cut_links = np.cumsum(n_a + n_b), np.cumsum(n_links)
    hashes, parts = [], []
    for k in range(len(ids)):
        lo, hi = cut_text[k] - n_a[k] - n_b[k], cut_text[k]
        hashes.append(hashlib.sha256("".join([pair.ends[x] for x in text[lo:hi].tolist()])[:-1].encode()).hexdigest() if hi > lo else "")
        parts.append(links[cut_links[k] - n_links[k] : cut_links[k]].tobytes())
    return pd.DataFrame({"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": hashes, "links": parts})


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links of each row of docs (doc_id, text), before any counting."""
    paths = paths or tokenizer_paths()
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair_of(*paths)
        for pdf in batches:
            ids, of, size = [], [], 0
            for k in range(0, len(pdf), 200):  # so that a batch of long texts is never tokenized whole
                part = pdf.iloc[k : k + 200]
                for i, x in zip(part["doc_id"], pair.ids(list(part["text"])), strict=True):
                    ids.append(x)
                    of.append(i)
                    size += len(x[0])
                    if size >= TOGETHER:
                        yield _align(pair, ids).assign(doc_id=pd.array(of, "Int64"))[_COLUMNS]
                        ids, of, size = [], [], 0
            if ids:
                yield _align(pair, ids).assign(doc_id=pd.array(of, "Int64"))[_COLUMNS]

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInPandas(run, schema)


_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]


def _kind(paths: tuple[str, str]) -> tuple[int, type]:
    """How many ids B has, and the numbers that stored links consist of."""
    pair = _pair_of(*paths)
    return len(pair.b_bytes), np.int32 if len(pair.a_bytes) * len(pair.b_bytes) < 2**31 else np.int64


def pair_counts(links: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """a_id, b_id, pair (both as one number), n (links that hold the pair) and best (no other pair of b_id has more)."""
    paths = paths or tokenizer_paths()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = _kind(paths)[1]
        keys, counts = np.zeros(0, kind), np.zeros(0, np.int64)

        def both(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            return out, np.bincount(at, np.concatenate([counts, n]), len(out)).astype(np.int64)

        for pdf in batches:
            for k in range(0, len(pdf), 500):
                got = np.unique(np.frombuffer(b"".join(pdf["links"].iloc[k : k + 500]), kind), return_counts=True)
                keys, counts = both(keys, counts, *got)
                if len(keys) > MOST_PAIRS:  # what one task holds; the rest is added up by Spark
                    yield pd.DataFrame({"pair": keys.astype(np.int64), "n": counts})
                    keys, counts = keys[:0], counts[:0]
        yield pd.DataFrame({"pair": keys.astype(np.int64), "n": counts})

    n_b = _kind(paths)[0]
    counted = links.select("links").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = stored(counted.select(F.expr(f"cast(pair div {n_b} AS int)").alias("a_id"), (F.col("pair") % n_b).cast("int").alias("b_id"), "pair", "n"), "pair-counts")
    # an id of B meets at most as many ids as A has, so these groups are bounded by the vocabularies
    top = counted.groupBy("b_id").agg(F.max("n").alias("_top"))
    return stored(counted.join(top, "b_id").select("a_id", "b_id", "pair", "n", (F.col("n") == F.col("_top")).alias("best")), "pair-bests")


def align(docs: DataFrame, paths: tuple[str, str] | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Alignment of both tokenizers' tokens for each row of docs (doc_id, text).

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A null or empty text, and one that
    either tokenizer does not give back byte for byte, has no tokens: zeros and an empty groups_sha256. Repeated rows
    count each; a null doc_id is kept; a long text is aligned whole; an empty table gives no rows; other columns are
    ignored.
    """
    paths = paths or tokenizer_paths()
    made = stored(aligned(docs, paths).withColumn("_row", F.monotonically_increasing_id()), "links")
    counts = pair_counts(made, paths)
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() <= most_pairs:
        return _scored_by_table(made, counts, paths).select(*fields)
    return _scored_by_join(made, counts, paths).select(*fields)


def _scored_by_table(made: DataFrame, counts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """n_best and count_sum with the counts, of which there are few, in every task."""
    rows = counts.orderBy("pair").select("pair", "n", "best").toArrow()
    shared = made.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = _kind(paths)[1]
        pairs, n, best = shared.value
        pairs = pairs.astype(kind)
        for pdf in batches:
            sums, bests = [], []
            for data in pdf.pop("links"):
                at = np.searchsorted(pairs, np.frombuffer(data, kind))
                sums.append(int(n[at].sum()))
                bests.append(int(best[at].sum()))
            yield pdf.assign(count_sum=sums, n_best=bests)[_SCORED]

    columns = [c for c in _COLUMNS if c != "links"]
    types = dict(made.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", n_best long, count_sum long"
    return made.select(*columns, "links").mapInPandas(lambda it: (p.astype({"doc_id": "Int64"}) for p in run(it)), schema)


_SCORED = [c for c in _COLUMNS if c != "links"] + ["n_best", "count_sum"]


def _scored_by_join(made: DataFrame, counts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """n_best and count_sum with the counts joined to each row's distinct pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = _kind(paths)[1]
        for pdf in batches:
            for row, data in zip(pdf["_row"], pdf["links"], strict=True):
                pair, times = np.unique(np.frombuffer(data, kind), return_counts=True)
                yield pd.DataFrame({"_row": np.full(len(pair), row), "pair": pair.astype(np.int64), "_times": times})

    asked = stored(made.select("_row", "links").mapInPandas(run, "_row long, pair long, _times long"), "pairs-of-rows")
    per_row = join_counted(asked, counts.select("pair", "n", "best"), ["pair"])
    sums = per_row.groupBy("_row").agg(F.sum(F.col("_times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("n_best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return made.drop("links").join(sums, "_row", "left").select(*[c for c in _COLUMNS if c != "links"], zero("n_best"), zero("count_sum"))
