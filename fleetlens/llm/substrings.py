"""Exact removal of repeated passages: bytes covered by a string of 100 bytes that also starts earlier in the corpus.

1. Anchors. In every window of `length` bytes the K-byte string with the least hash is its anchor, so equal windows
   have equal anchors at equal places. Anchors (about one in 35 bytes) are matched by one shuffle; those that occur
   once cannot belong to a repeated window and go.
2. Pieces. A run of windows with one anchor is a piece. Equal pieces collapse to the earliest by a map-side combined
   aggregate, so groups of copies, however large, become one row.
3. Suffix arrays. Different pieces with one anchor may share some windows only. They are brought together, a bounded
   number for each task, and compared through suffix arrays built by linear grouping (suffixes.py). An anchor with more
   different pieces than one task should hold takes the exact way through an aggregate over its windows instead.
4. Removal. All windows of repeated anchors go, but for those that a piece's earliest place is left with.

Texts are shuffled once, compressed, into a table bucketed by doc_id; later joins with it move no text. Tasks look at
many short texts in one pass of numpy (BLOCK), not at each by itself.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bucketed, stored
from fleetlens.llm.shingles import mixed, powers
from fleetlens.llm.suffixes import repeated_windows

LENGTH, K = 100, 32
REACH = LENGTH - K + 1  # anchors to choose from in a window
_BYTES = np.random.default_rng(100).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = [(np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)), (np.uint64(31), np.uint64(1))]
_TOP = 2**63 - 1
PART = 1 << 20  # bytes of a text looked at together
BLOCK = 1 << 16  # bytes of short texts looked at together; its arrays fit a core's cache


def pieces_of(data: bytes) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: anchor hash, piece hash, first window, anchor's place in it, windows."""
    return pieces_in(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1:]


def pieces_in(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pieces of the texts x[ends[i] : ends[i + 1]], in order: i, then the columns of pieces_of."""
    out = [tuple(np.zeros(0, t) for t in (np.int64,) * 6)]
    for i, j in _ranges(ends, min(BLOCK, PART)):
        begin, end = int(ends[i]), int(ends[j])
        if end - begin < PART + LENGTH:
            out.append(_pieces(x[begin:end], ends[i : j + 1] - begin, i, 0))
            continue
        for at in range(0, end - begin - LENGTH + 1, PART):
            # every window lies in one part; a run cut between parts is two pieces, and different pieces are compared
            part = x[begin + at : min(begin + at + PART + LENGTH - 1, end)]
            out.append(_pieces(part, np.array([0, len(part)]), i, at))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _ranges(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Neighbouring texts with at most `size` bytes together; a longer text is by itself."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        yield i, j
        i = j


@lru_cache(maxsize=1)
def _scratch(size: int) -> tuple[np.ndarray, ...]:
    return tuple(np.empty(size, np.uint64) for _ in range(4))


def _space(size: int) -> tuple[np.ndarray, ...]:
    """Four arrays that every block is worked out in: new ones for each step would cost more than the arithmetic."""
    return _scratch(2 * BLOCK if size <= 2 * BLOCK else size)


def _pieces(x: np.ndarray, ends: np.ndarray, first: int, shift: int) -> tuple[np.ndarray, ...]:
    n = len(x)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    up, down = powers(n + 1)
    total, h, spare, least = (s[: n + 1] for s in _space(n + 1))
    total[0] = 0
    np.take(_BYTES, x, out=h[:n], mode="clip")  # any byte is an index; clip writes into out itself
    np.multiply(h[:n], up[:n], out=h[:n])
    np.cumsum(h[:n], out=total[1:])
    h, spare, least = h[: n - K + 1], spare[: n - K + 1], least[: n - K + 1]
    np.subtract(total[K:], total[: n - K + 1], out=h)
    h *= down[: n - K + 1]
    for bits, factor in _MIX:  # shingles.mixed, in place
        h ^= np.right_shift(h, bits, out=spare)
        h *= factor
    np.bitwise_and(h, ~_LOW, out=least)
    least |= np.arange(n - K + 1, dtype=np.uint64)
    width = 1
    while width < REACH:
        step = min(width, REACH - width)
        shorter = np.minimum(least[:-step], least[step:], out=spare[: len(least) - step])
        spare, least, width = least, shorter, width + step
    fresh = np.empty(len(least), bool)
    fresh[0] = True
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    # no run goes from one text into the next, nor over the windows that stand in two texts
    edges = np.concatenate([ends[:-1], ends[1:] - LENGTH + 1])
    fresh[edges[(edges > 0) & (edges < len(least))]] = True
    lo = np.flatnonzero(fresh)
    hi = np.append(lo[1:], len(least))
    text = np.searchsorted(ends, lo, "right") - 1
    inside = lo + LENGTH <= ends[text + 1]
    lo, hi, text = lo[inside], hi[inside], text[inside]
    anchor = (least[lo] & _LOW).astype(np.int64)
    left, windows = anchor - lo, hi - lo
    body = (total[hi + LENGTH - 1] - total[lo]) * down[lo]
    piece = mixed(body + h[anchor] * np.uint64(3) + (left * 128 + windows).astype(np.uint64))
    return text + first, h[anchor].view(np.int64), piece.view(np.int64), lo - ends[text] + shift, left, windows


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's strings one after another, and where each ends, from 0; null: none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _unpacked(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Compressed texts i to j of a column, about `size` bytes at once: i, j, the texts joined, where each ends, from 0."""
    expand, i, held, ends = zstandard.ZstdDecompressor(), 0, [], [0]
    for k, data in enumerate(column):
        held.append(expand.decompress(data.as_buffer()))
        ends.append(ends[-1] + len(held[-1]))
        if ends[-1] >= size or k + 1 == len(column):
            yield i, k + 1, b"".join(held), np.array(ends)
            i, held, ends = k + 1, [], [0]


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a column's lists one after another, and the row of each; null: none."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def _as_lists(values: np.ndarray, rows: np.ndarray, count: int) -> pa.Array:
    """Lists of the values by their rows, which ascend."""
    return pa.ListArray.from_arrays(np.searchsorted(rows, np.arange(count + 1)).astype(np.int32), pa.array(values))


def _keys(rows: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    return mixed(pieces.view(np.uint64) + rows.astype(np.uint64) * _STEP)


def _removed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches to remove from texts, by row: row, start, end. Given: places of pieces of repeated anchors, and of which
    pieces a text has the first place, with the windows that go there (gone, 72 bits; null: none)."""
    (piece, row), lo, shape = _lists(batch.column("piece")), *(_lists(batch.column(c))[0].to_numpy().astype(np.int64) for c in ("lo", "shape"))
    windows = shape & 127
    firsts, of = _lists(batch.column("firsts"))
    row2, lo2 = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(firsts):
        keys, asked = _keys(row, piece.to_numpy()), _keys(of, firsts.field("piece").to_numpy())
        marks = np.unpackbits(np.frombuffer(b"".join(firsts.field("gone").fill_null(bytes(9)).to_pylist()), np.uint8).reshape(-1, 9), axis=1)
        order = np.argsort(asked, kind="stable")
        begin = np.flatnonzero(np.append(True, asked[order][1:] != asked[order][:-1]))
        asked, marks = asked[order][begin], np.bitwise_and.reduceat(marks[order], begin, axis=0)  # rows of one doc_id
        near = np.minimum(np.searchsorted(asked, keys), len(asked) - 1)
        among = np.flatnonzero(asked[near] == keys)
        at = among[np.unique(keys[among], return_index=True)[1]]  # a piece's first place in its text
        windows[at] = 0
        which, w = np.nonzero(marks[near[at]])
        row2, lo2 = row[at][which], lo[at][which] + w
    some = windows > 0
    rows = np.concatenate([row[some], row2])
    order = np.argsort(rows, kind="stable")
    ends = np.concatenate([lo[some] + windows[some] + LENGTH - 1, lo2 + LENGTH])
    return rows[order], np.concatenate([lo[some], lo2])[order], ends[order]


def remove_repeats(docs: DataFrame, group_rows: int = 2000, most_pieces: int = 20_000, keep_text: bool = False) -> DataFrame:
    """Removes from each row of docs (doc_id, text) the bytes covered by repeated strings of LENGTH bytes.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the kept bytes as kept. Order is by
    doc_id, then place; rows with equal doc_id count as one document's, so that repeated rows don't remove each other;
    a null doc_id comes last. Null, empty and short texts lose nothing; an empty table gives no rows; other columns are
    ignored. group_rows: pieces that one task compares; most_pieces: of one anchor, beyond which windows are aggregated.
    """
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_TOP)).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            row, anchor, *_ = pieces_in(*_bytes(batch.column("text")))
            # an anchor that a text has more than once is listed twice, so that it counts as repeated
            order = np.lexsort((anchor, row))
            row, anchor = row[order], anchor[order]
            listed = np.ones(len(row), bool)
            listed[2:] = (row[2:] != row[:-2]) | (anchor[2:] != anchor[:-2])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "anchors": _as_lists(anchor[listed], row[listed], len(batch))})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in filter(len, batches):
            x, ends = _bytes(batch.column("text"))
            data = [x[a:b] for a, b in itertools.pairwise(ends.tolist())]
            mark = pa.array([zlib.crc32(d) << 31 | len(d) & 0x7FFFFFFF for d in data], pa.int64())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "mark": mark, "data": pa.array([squeeze.compress(d) for d in data], pa.binary())})

    rows = plain.mapInArrow(packed, "doc_id long, mark long, data binary").repartition(buckets, "doc_id").groupBy("doc_id", "mark").agg(F.first("data").alias("data"), F.count("*").alias("times"))
    texts = bucketed(rows, "texts", "doc_id", buckets)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by anchor, those that share theirs with the row before or the row behind."""
        doc = anchor = np.zeros(0, np.int64)  # the last row, held back until the one behind is seen
        shares = np.zeros(0, bool)
        for batch in filter(len, batches):
            doc, anchor = (np.append(held, batch.column(c).to_numpy()) for c, held in (("doc_id", doc), ("anchor", anchor)))
            same = anchor[1:] == anchor[:-1]
            shares = np.concatenate([shares, same] if len(shares) else [[False], same])
            shares[:-1] |= same
            at = np.flatnonzero(shares[:-1])
            yield pa.record_batch({"doc_id": pa.array(doc[at]), "anchor": pa.array(anchor[at])})
            doc, anchor, shares = doc[-1:], anchor[-1:], shares[-1:]
        yield pa.record_batch({"doc_id": pa.array(doc[shares]), "anchor": pa.array(anchor[shares])})

    # one shuffle and one sort; an anchor's rows are streamed past each other, never gathered
    anchors = plain.mapInArrow(anchored, "doc_id long, anchors array<bigint>").select("doc_id", F.explode("anchors").alias("anchor")).repartition(buckets, "anchor").sortWithinPartitions("anchor")
    wanted = anchors.mapInArrow(repeated, "doc_id long, anchor long").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))

    def piecewise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            wanted, of = _lists(batch.column("anchors"))
            wanted, out = wanted.to_numpy(), []
            for i, j, data, ends in _unpacked(batch.column("data")):
                row, anchor, piece, lo, left, windows = pieces_in(np.frombuffer(data, np.uint8), ends)
                # one text's anchors may be looked up in another's: what is repeated is so for both
                at = np.flatnonzero(np.isin(anchor, wanted[np.searchsorted(of, i) : np.searchsorted(of, j)]))
                out.append((row[at] + i, anchor[at], piece[at], lo[at].astype(np.int32), (left[at] * 128 + windows[at]).astype(np.int32)))
            row, *columns = (np.concatenate(c) for c in zip(*out, strict=True))
            lists = {name: _as_lists(c, row, len(batch)) for name, c in zip(("anchor", "piece", "lo", "shape"), columns, strict=True)}
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "mark": batch.column("mark")} | lists)

    held = texts.join(wanted, "doc_id").select("doc_id", "mark", "data", "anchors").mapInArrow(piecewise, "doc_id long, mark long, anchor array<bigint>, piece array<bigint>, lo array<int>, shape array<int>")
    places = bucketed(held, "places", "doc_id", buckets)

    # every different piece with the document that has it first; equal pieces meet after a map-side combine
    flat = places.select("doc_id", F.explode(F.arrays_zip("anchor", "piece")).alias("x")).select("doc_id", F.col("x.anchor").alias("anchor"), F.col("x.piece").alias("piece"))
    firsts = stored(flat.groupBy("anchor", "piece").agg(F.min("doc_id").alias("doc_id")), "first-pieces")
    varied = firsts.groupBy("anchor").agg(F.count("*").alias("different")).filter("different > 1")
    ask = firsts.join(varied, "anchor").groupBy("doc_id").agg(F.collect_list("piece").alias("asked"), F.collect_set(F.when(F.col("different") > most_pieces, F.col("anchor"))).alias("hot"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            (anchor, row), piece, lo, shape = _lists(batch.column("anchor")), *(_lists(batch.column(c))[0].to_numpy() for c in ("piece", "lo", "shape"))
            asked, of = _lists(batch.column("asked"))
            keys = _keys(row, piece)
            among = np.flatnonzero(np.isin(keys, _keys(of, asked.to_numpy())))
            at = np.sort(among[np.unique(keys[among], return_index=True)[1]])  # a piece's first place in its text
            row, anchor, piece, lo, left, windows = row[at], anchor.to_numpy()[at], piece[at], lo[at], shape[at] >> 7, shape[at] & 127
            body: list[bytes] = []
            for i, j, data, ends in _unpacked(batch.column("data")):
                some = slice(np.searchsorted(row, i), np.searchsorted(row, j))
                start = ends[row[some] - i] + lo[some]
                body.extend(data[a:b] for a, b in zip(start.tolist(), (start + windows[some] + LENGTH - 1).tolist(), strict=True))
            columns = {"anchor": anchor, "piece": piece, "doc_id": batch.column("doc_id").to_numpy()[row], "at": lo + left, "left": left, "windows": windows}
            hot = np.isin(anchor, _lists(batch.column("hot"))[0].to_numpy())
            yield pa.record_batch({k: pa.array(v) for k, v in columns.items()} | {"hot": pa.array(hot), "body": pa.array(body, pa.binary())})

    fields = "anchor long, piece long, doc_id long, at int, left int, windows int, hot boolean, body binary"
    both = texts.join(places.withColumnRenamed("mark", "mark2"), "doc_id").filter("mark <= mark2 AND mark >= mark2")  # not as a second join key: that would shuffle
    compared = stored(both.join(ask, "doc_id").select("doc_id", "data", "anchor", "piece", "lo", "shape", "asked", "hot").mapInArrow(contexts, fields), "piece-texts")
    groups = max(1, -(-compared.count() // group_rows))

    def sorted_out(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["anchor", "piece", "doc_id", "at"]).reset_index(drop=True)
        rank = np.empty(len(pdf), np.int64)
        rank[np.lexsort((pdf["at"], pdf["doc_id"]))] = np.arange(len(pdf))
        dup = repeated_windows(list(pdf["body"]), pdf["left"].to_numpy(np.int64), pdf["windows"].to_numpy(np.int64), rank, LENGTH)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "gone": [np.packbits(r).tobytes() for r in dup]})

    shown = compared.filter("NOT hot").drop("hot").groupBy(F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("_g")).applyInPandas(sorted_out, "doc_id long, piece long, gone binary")
    # the exact way for anchors with too many different pieces: the earliest place of every window
    window = F.explode(F.sequence(F.lit(0), F.col("windows") - 1))
    single = compared.filter("hot").select("anchor", "piece", "doc_id", "at", "left", "body", window.alias("w")).select("anchor", "piece", "doc_id", "at", "w", (F.col("left") - F.col("w")).alias("r"), F.xxhash64(F.expr(f"substring(body, w + 1, {LENGTH})")).alias("h"), F.md5(F.expr(f"substring(body, w + 1, {LENGTH})")).alias("m"))
    earliest = single.groupBy("anchor", "r", "h", "m").agg(F.min(F.struct("doc_id", "at")).alias("e"))
    late = single.join(earliest, ["anchor", "r", "h", "m"]).filter(F.struct("doc_id", "at") > F.col("e"))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros((len(pdf), 72), bool)
            for i, ws in enumerate(pdf["ws"]):
                out[i, ws] = True
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "gone": [np.packbits(r).tobytes() for r in out]})

    hot = late.groupBy("doc_id", "piece").agg(F.collect_set("w").alias("ws")).mapInPandas(bits, "doc_id long, piece long, gone binary")
    shown = stored(shown.union(hot), "window-marks")
    # at its first place a piece keeps what was not shown to stand earlier
    kept = firsts.join(shown, ["doc_id", "piece"], "left").groupBy("doc_id").agg(F.collect_list(F.struct("piece", "gone")).alias("firsts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            row, start, end = _removed(batch)
            out: list[tuple] = []
            for i, j, data, ends in _unpacked(batch.column("data")):
                some = slice(np.searchsorted(row, i), np.searchsorted(row, j))
                base = ends[row[some] - i]
                edge = np.bincount(base + start[some], minlength=len(data) + 1) - np.bincount(base + end[some], minlength=len(data) + 1)
                gone = np.cumsum(edge) > 0  # of the place behind the last byte too, where all has ended
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                first[ends] = gone[ends]  # a removed run does not go on from one text into the next
                left = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes() if gone.any() else data
                before, begun = (np.concatenate([[0], np.cumsum(c)])[ends] for c in (gone, first))
                kept = [left[a:b] for a, b in itertools.pairwise((ends - before).tolist())]
                sums = [hashlib.sha256(k).hexdigest() for k in kept]
                out.append((np.diff(ends), np.diff(before), np.diff(begun), sums) + (kept,) * keep_text)
            n_bytes, n_removed, n_spans = (pa.array(np.concatenate([o[c] for o in out])) for c in range(3))
            doc = batch.column("doc_id").to_numpy()
            columns = {"doc_id": pa.array(doc, mask=doc == _TOP), "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans}
            columns |= {"kept_sha256": pa.array([s for o in out for s in o[3]], pa.string()), "times": batch.column("times")}
            yield pa.record_batch(columns | ({"kept": pa.array([k for o in out for k in o[4]], pa.binary())} if keep_text else {}))

    lacking = places.withColumnRenamed("mark", "mark2")
    whole = texts.join(lacking, (texts["doc_id"] == lacking["doc_id"]) & (texts["mark"] <= lacking["mark2"]) & (texts["mark"] >= lacking["mark2"]), "left").select(texts["doc_id"], "times", "data", "piece", "lo", "shape")
    done = whole.join(kept, "doc_id", "left").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, times long" + ", kept binary" * keep_text)
    return done.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_", "times")
