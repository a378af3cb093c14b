"""Language-model scoring by Katz backoff: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

P(w | h) is d(c) c / den(h) where h w was seen c times in training, and else alpha(h) P(w | h'), h' being h without its
first word; a context that was not seen has weight 1. A word that was not seen is the one further word of the lowest
level, which has what discounts leave there. alpha(h) is what discounts leave in h over what the lower level gives to the
words not seen after h, so that probabilities after every context add up to 1.

1. Documents are grouped into chunks of some million tokens, stored once as compressed word numbers.
2. Every chunk asks for the counts of its distinct n-grams. Questions go to tasks by ranges of the n-gram's hash, so that
   a frequent n-gram is one question from each chunk. The answers, and a table of all n-grams with their counts, are
   stored by level and range; one chunk is told to be an n-gram's owner.
3. Level by level, owners add up for each context what its n-grams take; the answers are den and alpha of contexts, stored alike.
4. Chunks score their documents from the answers, by recursion over levels for every token.

Numpy works on sorted arrays inside tasks; Spark deals questions and answers. All that is gathered grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bucketed, stored
from fleetlens.llm.shingles import mixed, word_hashes

#: Tokens of a chunk (a longer document is a chunk of its own) and of a range, which bound what a task holds, and the counts that are discounted.
CHUNK, RANGE, DISCOUNTED = 1_200_000, 2_000_000, 5
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, compressed: high bytes and those of sorted differences take hardly any room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())


def _widen(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _sorted_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_widen(data, np.uint64), dtype=np.uint64)


def _deltas(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of hashes begins among sorted keys, and their end."""
    bounds = np.array([(2**64 * k) // n for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def chunks(docs: DataFrame, holdout: int = 7, held: int = 2, size: int = CHUNK) -> DataFrame:
    """Chunks of docs (doc_id, text): chunk, doc_ids, held flags, tokens of each document, distinct words and word numbers."""

    def packed(chunk: int, ids: list, held: list, tokens: list[np.ndarray]) -> pd.DataFrame:
        sizes = np.array([len(x) for x in tokens], np.int64)
        words, at = _distinct(np.concatenate(tokens))
        # frequent words get small numbers
        rank = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
        back = np.empty(len(rank), np.uint32)
        back[rank] = np.arange(len(rank), dtype=np.uint32)
        return pd.DataFrame({"chunk": [chunk], "doc_ids": [ids], "held": [np.array(held, bool).tobytes()], "sizes": [_squeeze(sizes)], "words": [_squeeze(words[rank])], "tokens": [_squeeze(back[at])]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, flags, tokens, n, made = [], [], [], 0, 0
        for pdf in batches:
            for i, h, text, task in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["held"], pdf["text"], pdf["task"], strict=True):
                ids.append(i)
                flags.append(h)
                tokens.append(np.append(word_hashes(text), END))
                n += len(tokens[-1])
                if n >= size:
                    yield packed((int(task) << 24) + made, ids, flags, tokens)
                    ids, flags, tokens, n, made = [], [], [], 0, made + 1
        if ids:
            yield packed((int(task) << 24) + made, ids, flags, tokens)

    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(text_id) % holdout == held).alias("held"), F.spark_partition_id().alias("task"))
    return rows.mapInPandas(run, "chunk long, doc_ids array<long>, held binary, sizes binary, words binary, tokens binary")


class _Chunk:
    """A chunk's tokens as n-grams of every level: distinct keys, and which one ends at each token."""

    def __init__(self, row: pd.Series, order: int) -> None:
        self.doc_ids, self.held = row["doc_ids"], np.frombuffer(row["held"], bool)
        self.sizes = _widen(row["sizes"], np.int64)
        words, tokens = _widen(row["words"], np.uint64), _widen(row["tokens"], np.uint32)
        gram, context = words[tokens], np.full(len(tokens), START)
        first = np.cumsum(self.sizes) - self.sizes
        self.trained = np.repeat(~self.held, self.sizes)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # by level: distinct keys, and the place of each token's
        self.contexts: list[np.ndarray] = []  # by level: the key of each token's context
        begin = START
        for level in range(order):
            if level:
                context = np.empty(len(tokens), np.uint64)
                context[1:] = gram[:-1]
                context[first] = begin
                gram = mixed(context * _ODD + words[tokens])
                begin = mixed(begin * _ODD + START)
            self.grams.append(_distinct(gram))
            self.contexts.append(context)

    def trained_counts(self, level: int) -> np.ndarray:
        keys, at = self.grams[level]
        return np.bincount(at[self.trained], minlength=len(keys)).astype(np.int64)


def _asked(level: int, chunk: int, keys: np.ndarray, ranges: int, **columns: np.ndarray) -> pd.DataFrame:
    """One question for each range of the keys, with numbers about every key."""
    cut = _ranges(keys, ranges)
    full = np.flatnonzero(np.diff(cut))
    parts = {c: [_squeeze(x[cut[k] : cut[k + 1]]) for k in full] for c, x in columns.items()}
    return pd.DataFrame({"level": level, "range": full, "chunk": chunk, "keys": [_deltas(keys[cut[k] : cut[k + 1]]) for k in full], **parts})


def _met(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All keys that chunks ask one range about: distinct keys, the place of each question's keys, its chunk, and cuts."""
    keys = [_sorted_keys(x) for x in pdf["keys"]]
    cuts = np.cumsum([0] + [len(x) for x in keys])
    distinct, at = _distinct(np.concatenate(keys))
    return distinct, at, np.repeat(np.arange(len(keys)), np.diff(cuts)), cuts.tolist()


_QUESTIONS = "level int, range int, chunk long, keys binary, n binary"
_COUNTS = "level int, range int, chunk long, keys binary, n binary, times array<long>, kinds long, total long"


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers to the questions of one range, its part of the n-gram table, and its counts of counts."""
    pdf = pdf.sort_values("chunk")
    level, where = pdf["level"].iloc[0], pdf["range"].iloc[0]
    keys, at, asker, cuts = _met(pdf)
    n = np.concatenate([_widen(x, np.int64) for x in pdf["n"]])
    total = np.bincount(at, n, len(keys)).astype(np.int64)
    # the first chunk that has a key in training is its owner
    owner = np.full(len(keys), len(pdf))
    seen = np.flatnonzero(n)
    np.minimum.at(owner, at[seen], asker[seen])
    answer = (total[at] * 2 + (owner[at] == asker)).astype(np.uint64)
    out = pd.DataFrame({"level": level, "range": where, "chunk": pdf["chunk"].to_numpy(), "n": [_squeeze(answer[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]})
    have = total > 0
    times = np.bincount(np.minimum(total[have], DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
    table = pd.DataFrame({"level": [level], "range": [where], "keys": [_deltas(keys[have])], "n": [_squeeze(total[have])], "times": [times.tolist()], "kinds": [int(have.sum())], "total": [int(total.sum())]})
    out = pd.concat([table, out], ignore_index=True).astype({"chunk": "Int64", "kinds": "Int64", "total": "Int64"}).astype({"times": object})
    out["times"] = [x if isinstance(x, list) else None for x in out["times"]]
    return out[["level", "range", "chunk", "keys", "n", "times", "kinds", "total"]]


def discounts(times: list[int]) -> np.ndarray:
    """d(c) for c = 0 to the largest discounted count, from how many n-grams were seen 1, 2, ... times.

    Good-Turing with Katz's correction; where counts of counts do not allow it (some are 0 or do not fall), half a
    count is taken off instead.
    """
    k = len(times) - 1
    n = np.array(times, float)
    plain = np.array([0.0] + [(r - 0.5) / r for r in range(1, k + 1)])
    if not (n > 0).all():
        return plain
    common = (k + 1) * n[k] / n[0]
    d = np.array([((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if common != 1 else -1.0 for r in range(1, k + 1)])
    return np.concatenate([[0.0], d]) if ((d > 0) & (d < 1)).all() else plain


def _mass(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return n * np.where(n < len(d), d[np.minimum(n, len(d) - 1)], 1.0)


class _Lowest:
    """The level of single words: what a known word takes, and what is left for an unknown one."""

    def __init__(self, times: list[int], total: int, d: np.ndarray) -> None:
        kept = total - sum(times[r - 1] * r * (1 - d[r]) for r in range(1, len(d)))
        self.d = d
        # where no count is discounted, the unknown word is as if seen once
        self.den = total if any(times[: len(d) - 1]) else total + 1
        self.left = 1 - kept / self.den

    def log(self, n: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(n > 0, np.log10(_mass(n, self.d) / self.den), np.log10(self.left))


def _answers(pdf: pd.DataFrame, kind: str, level: int, column: str, dtype: type) -> np.ndarray:
    rows = pdf[(pdf["kind"] == kind) & (pdf["level"] == level)].sort_values("range")
    return np.concatenate([np.zeros(0, dtype), *[_widen(x, dtype) for x in rows[column]]])


class _Scores:
    """log10 P of each token of a chunk, level by level, from the answers that the chunk got."""

    def __init__(self, chunk: _Chunk, answers: pd.DataFrame, lowest: _Lowest, d: list[np.ndarray]) -> None:
        self.chunk, self.answers, self.d = chunk, answers, d
        self.counts = [_answers(answers, "count", k, "n", np.uint64) for k in range(len(chunk.grams))]
        self.level = 0
        self.log = lowest.log(self.of_tokens(0))

    def of_tokens(self, level: int) -> np.ndarray:
        return (self.counts[level] >> np.uint64(1)).astype(np.int64)[self.chunk.grams[level][1]]

    def rise(self) -> None:
        """From one level to the next, whose contexts have been answered."""
        self.level += 1
        _, at = _distinct(self.chunk.contexts[self.level])
        den, alpha = (_answers(self.answers, "context", self.level, c, np.float64)[at] for c in ("den", "alpha"))
        n = self.of_tokens(self.level)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log = np.where(n > 0, np.log10(_mass(n, self.d[self.level]) / den), np.where(den > 0, np.log10(alpha), 0.0) + self.log)

    def owned(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each of the chunk's contexts of a level, over the n-grams it owns: counts, discounted counts, lower-level probability."""
        keys, at = self.chunk.grams[level]
        own = (self.counts[level] & np.uint64(1)).astype(bool)
        first = np.zeros(len(keys), np.int64)
        first[at[::-1]] = np.arange(len(at))[::-1]  # one token of each n-gram
        token = first[own]
        n = (self.counts[level][own] >> np.uint64(1)).astype(np.int64)
        contexts, place = _distinct(self.chunk.contexts[level])
        add = lambda x: np.bincount(place[token], x, len(contexts))
        return contexts, add(n), add(_mass(n, self.d[level])), add(10.0 ** self.log[token])


_CONTEXTS = "level int, range int, chunk long, keys binary, n binary, kept binary, lower binary"
_WEIGHTS = "level int, range int, chunk long, keys binary, den binary, alpha binary"


def _weighed(pdf: pd.DataFrame) -> pd.DataFrame:
    """den and alpha of the contexts of one range, to every chunk that asked, and as a part of the table of weights."""
    pdf = pdf.sort_values("chunk")
    level, where = pdf["level"].iloc[0], pdf["range"].iloc[0]
    keys, at, _, cuts = _met(pdf)
    n, kept, lower = (np.bincount(at, np.concatenate([_widen(x, np.float64) for x in pdf[c]]), len(keys)) for c in ("n", "kept", "lower"))
    # where no n-gram of a context is discounted, an unseen one is as if seen once
    full = (n > 0) & (kept > n - 1e-9 * np.maximum(n, 1))
    den = n + full
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.where(den > 0, np.where(full, 1 / den, 1 - kept / den) / np.maximum(1 - lower, 1e-300), 0.0)
    out = pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "den": [_squeeze(den[at[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)], "alpha": [_squeeze(alpha[at[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]})
    have = den > 0
    table = pd.DataFrame({"keys": [_deltas(keys[have])], "den": [_squeeze(den[have])], "alpha": [_squeeze(alpha[have])]})
    out = pd.concat([table, out], ignore_index=True).astype({"chunk": "Int64"})
    return out.assign(level=level, range=where)[["level", "range", "chunk", "keys", "den", "alpha"]]


def katz_scores(docs: DataFrame, order: int = 2, holdout: int = 7, held: int = 2, chunk: int = CHUNK, per_range: int = RANGE) -> DataFrame:
    """Scores every row of docs (doc_id, text) by a model of `order` words, learned from those that are not held out.

    A document is held out if crc32 of its doc_id as text, modulo `holdout`, is `held`. Its tokens are its words, A-Z as
    a-z, and an end. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one single words) and
    score, both sums of log10. A null or empty text is the end alone; a null doc_id is as an empty text for the
    checksum and kept; repeated rows count each; long texts are read whole; without training rows every token is the unknown one, with
    probability 1; an empty table gives no rows; other columns are ignored.
    """
    # chunks are written once, where every later step finds them without a shuffle
    state = bucketed(chunks(docs, holdout, held, chunk), "chunks", "chunk", max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if state.isEmpty():
        return docs.sparkSession.createDataFrame([], _SCORED)
    n_tokens = state.select("sizes").mapInPandas(lambda it: (pd.DataFrame({"n": [sum(int(_widen(x, np.int64).sum()) for x in pdf["sizes"])]}) for pdf in it), "n long").agg(F.sum("n")).first()[0]
    ranges = max(8, -(-n_tokens // per_range))

    def ask_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                c = _Chunk(row, order)
                for level in range(order):
                    yield _asked(level, row["chunk"], c.grams[level][0], ranges, n=c.trained_counts(level))

    counted = stored(state.mapInPandas(ask_counts, _QUESTIONS).groupBy("level", "range").applyInPandas(_counted, _COUNTS), "ngrams")
    # one short row for each level
    of = {r["level"]: r for r in counted.filter("chunk IS NULL").groupBy("level").agg(*[F.sum(F.col("times")[r]).alias(f"t{r}") for r in range(DISCOUNTED + 1)], F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).collect()}
    times = {k: [r[f"t{i}"] for i in range(DISCOUNTED + 1)] for k, r in of.items()}
    d = [discounts(times[k]) for k in range(order)]
    n, v = of[0]["total"], of[0]["kinds"]
    lowest = _Lowest(times[0], n, d[0])
    answers = counted.filter("chunk IS NOT NULL").select("chunk", F.lit("count").alias("kind"), "level", "range", "n", F.lit(None).cast("binary").alias("den"), F.lit(None).cast("binary").alias("alpha"))

    def ask_weights(level: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def ask(of_chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            row = of_chunk.iloc[0]
            s = _Scores(_Chunk(row, level + 1), got, lowest, d)
            for _ in range(1, level):
                s.rise()
            contexts, taken, kept, lower = s.owned(level)
            return _asked(level, row["chunk"], contexts, ranges, n=taken, kept=kept, lower=lower)

        return ask

    for level in range(1, order):
        asked = state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(ask_weights(level), _CONTEXTS)
        weights = stored(asked.groupBy("level", "range").applyInPandas(_weighed, _WEIGHTS), "backoff-weights")
        answers = answers.unionByName(weights.filter("chunk IS NOT NULL").select("chunk", F.lit("context").alias("kind"), "level", "range", F.lit(None).cast("binary").alias("n"), "den", "alpha"))

    def score(of_chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(of_chunk.iloc[0], order)
        s = _Scores(c, got, lowest, d)
        for _ in range(1, order):
            s.rise()
        seen = s.of_tokens(0)
        first = np.cumsum(c.sizes) - c.sizes
        total = lambda x: np.add.reduceat(x, first)  # noqa: E731  every document has a token at least
        return pd.DataFrame({
            "doc_id": pd.array([None if pd.isna(i) else int(i) for i in c.doc_ids], "Int64"), "held_out": c.held, "n_tokens": c.sizes, "n_known": total((seen > 0).astype(np.int64)), "train_tokens": n,
            "base_score": total(np.log10((seen + 1) / (n + v + 1))), "score": total(s.log),
        })

    return state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, _SCORED)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
