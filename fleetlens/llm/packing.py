"""Packing by shortest-pack-first over the length histogram.

Texts become token ids and are cut every `size` tokens. The histogram of piece lengths (at most `size` numbers) is
packed on the driver, lengths longest first, each into the shortest open pattern, the one with the most room left, and
into a new one where it does not fit there; only counts of patterns are kept. Patterns are then joined back to pieces by the rank of a piece among those of its
length. Ranks are made per (length, salt), so no length's pieces are ever ordered in one task.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import MIN_LONG, stored


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The tokenizer keeps four characters that str.split() takes for white space; texts with one are split by pattern.
_ODD = re.compile(r"[\x1c-\x1f]")
_RUN = re.compile(r"[^\x20\x09-\x0D]+")


# Marks that the tokenizer always parts from letters before them.
_MARKS = ".,;:!?|#$%&*"
# Fixed value: up to this letter lower-case words are composed already and lowering leaves them alone.
_LATIN = "\u024f"


def _byte_letters() -> str:
    """The letter that the tokenizer writes for each byte: printable ones stand for themselves, others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return "".join(chr(b) if b in own else chr(256 + next(rest)) for b in range(256))


class _Words(dict):
    """Token ids (little-endian 32-bit) of each run without white space; the tokenizer never joins across white space.

    New runs are learned together, marks at their ends apart from their letters. Words of Latin letters go to the
    tokenizer's model at once, as what its earlier steps (composing, lowering, splitting) do to them is plain; all
    else goes through the whole tokenizer, one call for a batch.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.most, self.tokenizer = most, Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def split(run: str) -> tuple[str, str]:
        letters = run.rstrip(_MARKS)
        low = letters.lower()
        if not low.isalpha() or len(low) != len(letters) or "\u03a3" in letters:  # Python lowers a last sigma by its place
            return run, ""
        return low, run[len(letters) :]

    def encode(self, texts: list[str]) -> None:
        """Learns parts: they are encoded as one text and told apart by where their tokens begin."""
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        at = np.searchsorted(starts, [a for a, _ in got.offsets], "right") - 1
        ids, ends = np.array(got.ids, "<u4"), np.searchsorted(at, np.arange(len(texts) + 1))
        data = ids.tobytes()
        self.parts |= {t: data[4 * ends[k] : 4 * ends[k + 1]] for k, t in enumerate(texts)}

    def encode_words(self, texts: list[str]) -> None:
        """Learns lower-case words of Latin letters."""
        tokens, put = self.model.tokenize, struct.pack
        for t in texts:
            ids = [x.id for x in tokens(t if t.isascii() else t.encode().decode("latin-1").translate(self.letters))]
            self.parts[t] = put(f"<{len(ids)}I", *ids)

    def learn(self, runs: set[str]) -> None:
        new = runs.difference(self)
        if len(self) + len(new) > self.most:
            self.clear()
            new = runs
        if len(self.parts) > 2 * self.most:
            self.parts.clear()
        known, put = self.parts, self.__setitem__
        # most runs are words, alone or with marks behind them; no tuples are kept for those
        words = {r: r.lower() for r in new if r.isascii() and r.isalpha()}
        marked = {r: self.split(r) for r in new.difference(words)}
        missing = {p for p in words.values() if p not in known}
        missing.update(p for h in marked.values() for p in h if p and p not in known)
        plain = [p for p in missing if p.isalpha() and p.islower() and (p.isascii() or max(p) <= _LATIN)]
        self.encode_words(plain)
        rest = sorted(missing.difference(plain))
        for k in range(0, len(rest), 4000):
            self.encode(rest[k : k + 4000])
        for r, low in words.items():
            put(r, known[low])
        for r, (low, marks) in marked.items():
            put(r, known[low] + known[marks] if marks else known[low])

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), 1000):
            runs = [_RUN.findall(t) if _ODD.search(t) else t.split() for t in texts[k : k + 1000]]
            self.learn(set().union(*runs))
            get = self.__getitem__
            out += [b"".join(map(get, r)) for r in runs]
        return out


@lru_cache(maxsize=2)
def _words_of(path: str) -> _Words:
    return _Words(path)


def token_ids(texts: list[str | None], path: str, end_id: int = 1) -> list[bytes]:
    return [x + end_id.to_bytes(4, "little") for x in _words_of(path).ids([t or "" for t in texts])]


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Token pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, and ids where asked for."""
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, ids in zip(pdf["doc_id"].astype("Int64"), token_ids(list(pdf["text"]), path, end_id), strict=True):
                n = len(ids) // 4
                for a in range(0, n, size):
                    part = ids[4 * a : 4 * (a + size)]
                    out.append((i, a, len(part) // 4, zlib.crc32(part), n) + (part,) * keep_ids)
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInPandas(run, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, how many in one pack)], packs) that hold every counted piece.

    Lengths go longest first; a length goes into the shortest open packs, as many at once as share a pattern, and
    where even those have too little room, into new ones, one piece in each. A pack that got a piece has less room
    than before, so it is not the shortest any more; only packs that are the only ones left take a second piece of the
    same length at once. Work is bounded by the number of distinct lengths and patterns, not by the number of pieces.
    """
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # room left -> patterns and their counts
    rooms: list[int] = []

    def add(room: int, pattern: tuple[tuple[int, int], ...], packs: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((pattern, packs))

    def with_one(pattern: tuple[tuple[int, int], ...], length: int) -> tuple[tuple[int, int], ...]:
        if pattern and pattern[-1][0] == length:
            return (*pattern[:-1], (length, pattern[-1][1] + 1))
        return (*pattern, (length, 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if not rooms or rooms[-1] < length:
                # new packs, only as many as the pieces need that fill each other up: a new pack stays the shortest
                fit = size // length
                packs = left // fit
                if packs:
                    add(size - fit * length, ((length, fit),), packs)
                if left % fit:
                    add(size - left % fit * length, ((length, left % fit),), 1)
                break
            room = rooms[-1]
            pattern, packs = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop()
            filled = min(packs, left)
            add(room - length, with_one(pattern, length), filled)
            if packs > filled:
                add(room, pattern, packs - filled)
            left -= filled
    return [(list(p), n) for rows in open_.values() for p, n in rows]


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 1, keep_ids: bool = False, per_salt: int = 200_000) -> DataFrame:
    """Packs the tokens of all rows of docs (doc_id, text) into sequences of `size` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian 32-bit, where
    asked for), one row per piece. A null or empty text is the end id alone; repeated rows are packed each; a null
    doc_id is kept; an empty table gives no rows; other columns are ignored.
    """
    path = path or tokenizer_path()
    cut = stored(pieces(docs, path, size, end_id, keep_ids).withColumn("_tie", F.monotonically_increasing_id()), "pieces")
    total = cut.count()
    salts = max(8, -(-total // per_salt))
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_tie"), F.lit(salts)).cast("int"))
    counts = cut.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    # at most `size` rows reach the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # For each length, in rank order: how many ranks a pattern takes, where its packs begin and where in a pack.
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for pattern, packs in shortest_pack_first(histogram, size):
        offset = 0
        for length, fit in pattern:
            plan.setdefault(length, []).append((packs * fit, fit, base, offset))
            offset += fit * length
        base += packs
    tables = {k: (np.cumsum([0] + [x[0] for x in v])[:-1], np.array([x[1:] for x in v])) for k, v in plan.items()}
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "_salt", "_before")
    own = Window.partitionBy("length", "_salt").orderBy(F.coalesce("doc_id", F.lit(MIN_LONG)), "start", "_tie")
    ranked = cut.withColumn("_own", F.row_number().over(own) - 1).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_before")).drop("_salt", "_own", "_before", "_tie")
    # the tables hold a few entries for each of at most `size` lengths
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    fields = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset int" + ", ids binary" * keep_ids

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, rows = shared.value[int(length)]
                k = np.searchsorted(first, ranks[at], "right") - 1
                within = ranks[at] - first[k]
                fit, start, begin = rows[k].T
                sequence[at] = start + within // fit
                offset[at] = begin + within % fit * length
            out = pdf.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)
            yield out.astype({"doc_id": "Int64", "offset": "int32"})

    columns = [x.split()[0] for x in fields.split(", ")]
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids, "_rank").mapInPandas(lambda it: (p[columns] for p in place(it)), fields)
