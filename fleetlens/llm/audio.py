"""Audio columns: 8-bit WAV storage, polyphase resampling, log-mel filterbanks, hysteresis segments, Arrow tensors.

Each clip is worked on by itself in blocks of frames, so memory stays bounded by one clip's bytes and its tensor, and
equal clips give equal values whatever batch they travel in.
"""

from __future__ import annotations

import hashlib
import io
import math
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class AudioSpec:
    rate: int = 16_000
    up: int = 3
    down: int = 4
    taps: int = 12  # for each phase
    window: int = 300
    hop: int = 120
    fft: int = 512
    mels: int = 32
    rows: int = 32  # frames in one tensor
    overlap: int = 8  # frames that neighbouring tensors share
    high_db: float = 1.0  # over the clip's mean level: a segment begins
    low_db: float = -1.0  # under it: a segment ends
    block: int = 1024  # frames worked on at once


@lru_cache(maxsize=4)
def _phases(s: AudioSpec) -> np.ndarray:
    """Windowed-sinc low-pass, split into `up` phases of `taps` coefficients, each reversed for a dot product."""
    n = s.up * s.taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(s.up, s.down)
    h = np.sinc(t * cut) * np.hamming(n)
    h *= s.up / h.sum()
    return np.stack([h[p :: s.up][::-1] for p in range(s.up)]).astype(np.float32)


@lru_cache(maxsize=4)
def _mel_bank(s: AudioSpec) -> np.ndarray:
    rate = s.rate * s.up / s.down
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), s.mels + 2) / 2595) - 1)
    f = np.arange(s.fft // 2 + 1) * rate / s.fft
    rise = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resample(x: np.ndarray, s: AudioSpec, first: int, count: int) -> np.ndarray:
    """Output samples first .. first + count of x resampled by up / down; x is taken as zero outside."""
    h = _phases(s)
    pos = (first + np.arange(count, dtype=np.int64)) * s.down
    base, phase = pos // s.up, pos % s.up
    lo = int(base[0]) - s.taps + 1 if count else 0
    hi = int(base[-1]) + 1 if count else 0
    part = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(x))
    if b > a:
        part[a - lo : b - lo] = x[a:b]
    views = np.lib.stride_tricks.sliding_window_view(part, s.taps)
    out = np.empty(count, np.float32)
    for p in range(s.up):
        at = np.flatnonzero(phase == p)
        out[at] = views[base[at] - s.taps + 1 - lo] @ h[p]
    return out


def log_mel(samples: np.ndarray, s: AudioSpec) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels log energies, frame levels in dB) of unsigned 8-bit samples after resampling."""
    x = (samples.astype(np.float32) - 128) / 128
    total = math.ceil(len(x) * s.up / s.down)
    frames = max(1, 1 + max(0, total - s.window + s.hop - 1) // s.hop)
    mel, level = np.empty((frames, s.mels), np.float32), np.empty(frames, np.float32)
    taper = np.hanning(s.window).astype(np.float32)
    for k in range(0, frames, s.block):
        n = min(s.block, frames - k)
        y = resample(x, s, k * s.hop, (n - 1) * s.hop + s.window)
        cut = np.lib.stride_tricks.sliding_window_view(y, s.window)[:: s.hop] * taper
        power = np.abs(np.fft.rfft(cut, s.fft)) ** 2
        mel[k : k + n] = np.log(power.astype(np.float32) @ _mel_bank(s) + 1e-6)
        level[k : k + n] = 10 * np.log10((cut**2).mean(axis=1) + 1e-10)
    return mel, level


def segments(level: np.ndarray, s: AudioSpec) -> list[tuple[int, int]]:
    """Runs of frames [a, b) that begin above mean + high_db and last until the level falls below mean + low_db."""
    mark = np.where(level > level.mean() + s.high_db, 1, np.where(level < level.mean() + s.low_db, 0, -1))
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(known >= 0, mark[np.maximum(known, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray, s: AudioSpec) -> pa.Table:
    """The clip's log-mel frames as overlapping tensors of fixed shape (rows x mels, zero-padded) with time spans."""
    step, second = s.rows - s.overlap, s.hop / (s.rate * s.up / s.down)
    starts = range(0, max(1, len(mel) - s.overlap), step)
    data = np.zeros((len(starts), s.rows, s.mels), np.float32)
    for k, a in enumerate(starts):
        part = mel[a : a + s.rows]
        data[k, : len(part)] = part
    ends = [min(a + s.rows, len(mel)) for a in starts]
    return pa.table({"start_s": pa.array([a * second for a in starts]), "end_s": pa.array([b * second for b in ends]), "logmel": pa.FixedShapeTensorArray.from_numpy_ndarray(data)})


def to_ipc(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue()


def to_wav(payload: bytes, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as r:
        return r.readframes(r.getnframes())


def read_tensors(data: bytes) -> pa.Table:
    """Inverse of the stored tensors column."""
    return pa.ipc.open_stream(data).read_all()


def read_frames(table: pa.Table, s: AudioSpec) -> np.ndarray:
    """The log-mel frames of a clip out of its stored tensors: overlaps once, padding left out."""
    data = table["logmel"].combine_chunks().to_numpy_ndarray()
    second, step = s.hop / (s.rate * s.up / s.down), s.rows - s.overlap
    counts = np.rint((np.asarray(table["end_s"]) - np.asarray(table["start_s"])) / second).astype(int)
    return np.concatenate([t[: n if k == len(data) - 1 else step] for k, (t, n) in enumerate(zip(data, counts, strict=True))])


def spans_table(spans: list[tuple[int, int]], s: AudioSpec) -> pa.Table:
    second = s.hop / (s.rate * s.up / s.down)
    return pa.table({"start_s": pa.array([a * second for a, _ in spans], pa.float64()), "end_s": pa.array([b * second for _, b in spans], pa.float64())})


def padded(data: bytes, to: int = 64) -> bytes:
    """data with zero bytes up to a positive multiple of `to`."""
    return data + bytes(max(to, -(-len(data) // to) * to) - len(data))


def features(docs: DataFrame, spec: AudioSpec = AudioSpec(), keep: tuple[str, ...] = ("media", "tensors", "spans")) -> DataFrame:
    """Stores each text of docs (doc_id, text) as a WAV clip, reads it back and computes its features.

    Tensors and energy segments are written as Arrow IPC streams and read back from those bytes; feature is computed of
    what was read. Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (a digest: frames, tensors, segments, active frames, mean log-mel in tenths, checksum of the rounded
    frames), n_frames, tensors_bytes and tensors_sha256 (of the tensors' stream), and as named in `keep`: media (binary,
    WAV), tensors (binary, an Arrow IPC stream of start_s, end_s and the fixed-shape tensor logmel), spans (array of
    start_s, end_s: the energy segments).
    Null and empty texts are 64 zero bytes; a long text is one clip, worked on in blocks of frames; null doc_id and
    repeated rows pass through; every input row gives one row, an empty table none; other columns are ignored.
    """
    extra = {"media": "media binary", "tensors": "tensors binary", "spans": "spans array<struct<start_s: double, end_s: double>>"}
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, tensors_bytes long, tensors_sha256 string" + "".join(f", {extra[k]}" for k in keep)

    def clip(text: str | None) -> tuple:
        data = (text or "").encode()
        media = to_wav(padded(data), spec.rate)
        back = from_wav(media)
        mel, level = log_mel(np.frombuffer(back, np.uint8), spec)
        spans = segments(level, spec)
        held, segmented = to_ipc(tensors(mel, spec)), to_ipc(spans_table(spans, spec))
        table, times = read_tensors(held), read_tensors(segmented).to_pylist()
        frames, second = read_frames(table, spec), spec.hop / (spec.rate * spec.up / spec.down)
        means = np.rint(frames.mean(axis=0, dtype=np.float64) * 10).astype(int)
        check = zlib.crc32(np.rint(frames * 8).astype("<i2").tobytes())
        active = sum(round((x["end_s"] - x["start_s"]) / second) for x in times)
        feature = f"{len(frames)}:{len(table)}:{len(times)}:{active}:{','.join(map(str, means))}:{check:08x}"
        out = [len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), len(held), hashlib.sha256(held).hexdigest()]
        more = {"media": lambda: media, "tensors": lambda: held, "spans": lambda: times}
        return (*out, *(more[k]() for k in keep))

    names = [x.split()[0] for x in schema.split(", ")][:11] + list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # a few texts at a time: what is kept of them can be many times their size
            for k in range(0, max(1, len(pdf)), 256):
                part = pdf.iloc[k : k + 256]
                rows = [(i, *clip(t)) for i, t in zip(part["doc_id"].astype("Int64"), part["text"], strict=True)]
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInPandas(run, schema)
