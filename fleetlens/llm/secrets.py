"""Secret scan: a small character convolutional network over every candidate and its context.

Patterns give base findings, which stay, and wider candidates (long tokens that mix letters and digits, values after
further key words). The network reads every candidate whole, in overlapping windows if it is long, with the characters
around it, and a candidate's score is that of its most secret-like window. It is trained on labelled findings of all
documents: their base findings, and findings whose label is known because they were generated into a context of each
document. Candidates that no rule confirms have no label and are not learned from.

1. Spark cuts windows out of every document; each distinct one is kept once and dealt by its hash to groups of bounded size.
2. In rounds, groups go on training the same network side by side, in numpy, and Spark takes the mean of their weights.
3. Windows of held-out documents are scored and counted by their rounded logit. Scores are calibrated on these counts, and
   the threshold is the highest that keeps the wished recall there; it is exact, since a score depends on that logit alone.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import clear, made, stored, uniform
from fleetlens.llm.spans import Span, digest, joined

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token")

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
# Further words that stand before secrets.
_VALUE = re.compile(r"""(?i:pwd|passphrase|private_?key|access_?key|client_?secret|auth|credential|bearer)["']?\x20{0,4}[:=\x20]\x20{0,4}["']?([A-Za-z0-9+/_.=-]{8,})""", re.ASCII)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}")

# One of these stands in every text that has such a finding; runs of a length lie within what white space separates.
_ASSIGN_HAS = ("passw", "secret", "token", "apikey", "api_key")
_VALUE_HAS = ("pwd", "passphrase", "privatekey", "private_key", "accesskey", "access_key", "clientsecret", "client_secret", "auth", "credential", "bearer")

_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")

BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Character classes of the one-byte alphabet: printable ASCII as itself, 0 for padding, 1 for anything else.
ALPHABET = 97

#: Documents, and bytes of text, for each group that the network is trained on in one task; what bounds a group.
GROUP_DOCS, GROUP_BYTES = 1000, 4_000_000
#: Rounds of training, after each of which the groups' weights are averaged.
ROUNDS = 10
#: One finding's weight, dealt out over its windows, and the fixed point of weights that are added up, so that sums have no order.
WHOLE = 2**20


def _has(text: str, words: tuple[str, ...]) -> bool:
    low = text.lower()
    return any(w in low for w in words)


def _has_run(text: str, size: int) -> bool:
    return any(len(w) >= size for w in text.split())


def base_spans(text: str) -> list[Span]:
    out = []
    if _has(text, _ASSIGN_HAS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    if _has_run(text, 32):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Long mixed tokens, and values behind further key words, that no base finding overlaps; one sweep over both."""
    found = set()
    if _has_run(text, 20):
        found |= {m.span() for m in _TOKEN.finditer(text) if _LETTER.search(m[0])}
    if _has(text, _VALUE_HAS):
        found |= {m.span(1) for m in _VALUE.finditer(text) if _DIGIT.search(m[1])}
    out, taken, at, done = [], sorted(base), 0, 0
    reach = 0  # where the base findings seen so far end
    for a, b in sorted(found):
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= a and done <= a:
            out.append((a, b, "token"))
            done = b
    return out


def _codes(text: str) -> list[int]:
    return [ord(c) - 30 if 32 <= ord(c) < 127 else 1 for c in text]


def windows(text: str, span: Span) -> np.ndarray:
    """The characters before, in and after the candidate, each part at a fixed place; windows x WIDTH codes.

    A candidate of more than INSIDE characters is read in windows that overlap by half, so every character is read.
    """
    a, b, _ = span
    starts = range(a, max(a + 1, b - INSIDE // 2), INSIDE // 2)
    out = np.zeros((len(starts), WIDTH), np.uint8)
    for row, x in zip(out, starts, strict=True):
        y = min(b, x + INSIDE)
        before, inside, after = _codes(text[max(0, x - BEFORE) : x]), _codes(text[x:y]), _codes(text[y : y + AFTER])
        row[BEFORE - len(before) : BEFORE] = before
        row[BEFORE : BEFORE + len(inside)] = inside
        row[BEFORE + INSIDE : BEFORE + INSIDE + len(after)] = after
    return out


def _inside(x: np.ndarray) -> np.ndarray:
    """The share that each place of the candidate has in it; padding has none."""
    there = (x[:, BEFORE : BEFORE + INSIDE] > 0).astype(float)
    return there / np.maximum(there.sum(1, keepdims=True), 1)


@dataclass
class CharNet:
    """Embedding, one convolution with ReLU, maximum over the candidate and over its context, mean over the candidate
    (how much of it is alike, where the maximum tells only what is there), logistic output."""

    seed: int = 7
    dim: int = 8
    filters: int = 24
    size: int = 5
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        k = self.size * self.dim
        self.weights = self.weights or {"e": rng.normal(0, 0.5, (ALPHABET, self.dim)), "w": rng.normal(0, k**-0.5, (k, self.filters)), "b": np.zeros(self.filters), "v": rng.normal(0, 0.2, 3 * self.filters), "c": np.zeros(1)}

    def _forward(self, x: np.ndarray) -> tuple:
        p = self.weights
        emb = p["e"][x]
        n, length = len(x), WIDTH - self.size + 1
        cols = np.lib.stride_tricks.sliding_window_view(emb, self.size, axis=1).transpose(0, 1, 3, 2).reshape(n * length, -1)
        h = np.maximum(0, cols @ p["w"] + p["b"]).reshape(n, length, -1)
        inner = slice(BEFORE - 2, BEFORE + INSIDE - 2)
        outer = h.copy()
        outer[:, inner] = 0
        at = np.concatenate([h[:, inner].argmax(1) + BEFORE - 2, outer.argmax(1)], axis=1)
        share = _inside(x)
        pooled = np.concatenate([h[:, inner].max(1), outer.max(1), 4 * (h[:, inner] * share[:, :, None]).sum(1)], axis=1)
        return cols, h, at, share, pooled, pooled @ p["v"] + p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Rounded, so that they can be counted."""
        return np.concatenate([np.round(np.clip(self._forward(x[k : k + 64])[-1], -30, 30), 3) for k in range(0, len(x), 64)]) if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(self.logits(x))

    def _scaled(self, z: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return np.round(1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))), 4)

    def best(self, of: list[np.ndarray]) -> np.ndarray:
        """For each candidate, given by its windows, the score of the highest; a few thousand windows at once."""
        counts = [len(x) for x in of]
        if not counts:
            return np.zeros(0)
        every = np.concatenate(of)
        score = np.concatenate([self.scores(every[k : k + 4096]) for k in range(0, len(every), 4096)])
        return np.maximum.reduceat(score, np.concatenate([[0], np.cumsum(counts)[:-1]]))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, part: np.ndarray | None = None) -> None:
        """Adam on the logistic loss; `part`: how much each window weighs."""
        part = np.ones(len(x)) if part is None else part
        p, rng = self.weights, np.random.default_rng(self.seed)
        m, v, t = {k: 0 * a for k, a in p.items()}, {k: 0 * a for k, a in p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                at = order[k : k + batch]
                cols, h, peak, share, pooled, z = self._forward(x[at])
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * part[at] / part[at].sum()
                dp = d[:, None] * p["v"]
                two = 2 * self.filters
                dh = np.zeros_like(h)
                rows, f = np.arange(len(at))[:, None], np.tile(np.arange(self.filters), 2)[None]
                np.add.at(dh, (rows, peak, f), dp[:, :two] * (pooled[:, :two] > 0))
                inner = slice(BEFORE - 2, BEFORE + INSIDE - 2)
                dh[:, inner] += 4 * share[:, :, None] * dp[:, None, two:] * (h[:, inner] > 0)
                dh = dh.reshape(len(cols), -1)
                dc = (dh @ p["w"].T).reshape(len(at), h.shape[1], self.size, self.dim)
                dx = np.zeros((len(at), WIDTH, self.dim))
                for j in range(self.size):
                    dx[:, j : j + h.shape[1]] += dc[:, :, j]
                places = x[at].astype(np.int64)[:, :, None] * self.dim + np.arange(self.dim)
                de = np.bincount(places.ravel(), dx.ravel(), ALPHABET * self.dim).reshape(ALPHABET, self.dim)
                grads = {"e": de, "w": cols.T @ dh, "b": dh.sum(0), "v": pooled.T @ d, "c": np.array([d.sum()])}
                t += 1
                for name, g in grads.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    p[name] = p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, of: np.ndarray | None = None) -> None:
        """Platt scaling on held-out findings, then the highest threshold that keeps `recall` of the true ones (`of`: of those)."""
        self.calibrate_counted(self.logits(x), y, np.ones(len(x)), recall, of)

    def calibrate_counted(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float, of: np.ndarray | None = None) -> None:
        """The same, given logits, labels and how often they come together."""
        a, b, total, positive = 1.0, 0.0, n.sum(), n[y > 0].sum()
        goal = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (total - positive + 2))
        for _ in range(400):
            d = (1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - goal) * n / total
            a, b = a - 0.05 * float((d * z).sum()), b - 0.05 * float(d.sum())
        self.scale = (a, b)
        chosen = y > 0 if of is None or not (of & (y > 0)).any() else of & (y > 0)
        score = self._scaled(z[chosen])
        order = np.argsort(score, kind="stable")
        below = np.cumsum(n[chosen][order])
        self.threshold = float(score[order][np.searchsorted(below, (1 - recall) * below[-1], side="right")]) if len(below) else 1.0


_HEXITS, _CAPITALS, _SMALL = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits
_ALNUM = string.ascii_letters + string.digits


def _secret(rng: random.Random) -> tuple[str, str]:
    """A value such as keys have, and what may stand right before it."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    n = rng.randint(20, 48)
    kind = rng.randrange(11)
    if kind == 0:
        value = pick(_ALNUM, n)
    elif kind == 1:
        value = pick(_ALNUM + "+/", n) + rng.choice(["", "=", "=="])
    elif kind == 2:
        value = rng.choice(["ghp_", "sk_live_", "xoxb-", "pat-", "key-", "rk_"]) + pick(_ALNUM, n)
    elif kind == 3:
        value = pick(_CAPITALS, n)
    elif kind in (4, 5):
        value = pick(_SMALL, n)
    elif kind == 6:
        value = pick(_ALNUM + "_-", n)
    elif kind == 7:
        value = "eyJ" + pick(_ALNUM, rng.randint(20, 60))
    elif kind == 8:  # an issuer's letters, perhaps with a version, before any alphabet
        value = pick(string.ascii_letters, rng.randint(2, 6)) + rng.choice(["_", "-", "_v1_", "_live_"]) + pick(rng.choice([_ALNUM, _HEXITS, _SMALL, _ALNUM + "-_", _CAPITALS]), rng.randint(24, 48))
    else:  # a short value behind a further key word
        value = pick(rng.choice([_ALNUM, _ALNUM, _SMALL, _ALNUM + "+/_.-", _ALNUM + "._-"]), rng.randint(8, 19)) + rng.choice("0123456789")
        return value, rng.choice(["pwd=", "pwd: ", "passphrase: ", "private_key=", "client_secret: ", "auth=", "credential: ", "bearer "])
    return value, rng.choice(["", "key ", "auth: ", "id=", '"', "(", "value "])


def _harmless(rng: random.Random, words: list[str]) -> tuple[str, str]:
    """A long mixed token that is no secret, and what may stand right before it."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    number = lambda: str(rng.randint(0, 9999))
    word = lambda: rng.choice(words).lower()
    groups = lambda chars, sizes, mark: mark.join(pick(chars, k) for k in sizes)
    same = rng.randint(3, 6)
    value = rng.choice(
        [
            lambda: "-".join(word() for _ in range(4)) + f"-{number()}",
            lambda: "_".join(rng.choice(words) for _ in range(5)) + f"_v{rng.randint(1, 9)}",
            lambda: f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}-00-00Z-log",
            lambda: "/".join(word() for _ in range(5)) + f"/page{rng.randint(1, 99)}",
            lambda: (rng.choice(words) * 12)[:24] + number(),
            lambda: rng.choice("=-_x") * rng.randint(20, 40) + number() + "a",
            lambda: groups(_HEXITS, (8, 4, 4, 4, 12), "-"),  # identifiers
            lambda: groups(_HEXITS, (8, 4, 4, 4, 12), "-").upper(),
            lambda: groups(_CAPITALS, [same] * rng.randint(4, 6), rng.choice("-_")),  # serial numbers
            lambda: rng.choice(["SN", "INV", "LOT", "ID"]) + "-" + groups(string.digits, [rng.randint(3, 6) for _ in range(rng.randint(3, 5))], "-"),
            lambda: groups("0123456789", [rng.randint(2, 5) for _ in range(rng.randint(5, 8))], "-") + rng.choice("abcx"),
            lambda: rng.choice(["sha256-", "sha512-", "md5-"]) + pick(_ALNUM + "+/", 43) + "=",  # digests
            lambda: pick(string.digits, rng.randint(20, 30)) + rng.choice("kmx"),
            lambda: "".join(rng.choice(words).capitalize() for _ in range(5)) + number(),
            lambda: word() + "_" + "_".join(f"{word()}{rng.randint(1, 99)}" for _ in range(3)),
            lambda: f"/{word()}/{word()}/{rng.randint(2000, 2030)}/{rng.randint(1, 12)}/{word()}-{word()}-{number()}",
        ]
    )()
    return value, rng.choice(["", "key ", "id=", '"', "(", "see ", "file ", "order ", "serial: ", "ref "])


def _generated(rng: random.Random, context: str, each: int = 3) -> list[tuple[str, Span, int]]:
    """`each` true and false findings put into a context; their labels are known from how they are made."""
    words = [w for w in re.findall(r"[A-Za-z]{2,10}", context)] or ["alpha", "beta"]
    out = []
    for k in range(2 * each):
        value, before = _harmless(rng, words) if k % 2 else _secret(rng)
        lead = context[:40] + rng.choice([" ", "\n"]) + before
        out.append((lead + value + rng.choice(['"', " ", "\n", ". ", ", "]) + context[40:60], (len(lead), len(lead) + len(value), "token"), 1 - k % 2))
    return out


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, text, u (a number that depends on both) and mark (a hash of the text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("*", uniform("doc_id", F.xxhash64("text"), seed=seed).alias("u"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("mark"))


def _least(rows: DataFrame, max_docs: int) -> DataFrame:
    """At most max_docs rows, those of least u; copies have one, and come as often as there is room."""
    cut_off = rows.select("u").orderBy("u").limit(max_docs).agg(F.max("u")).first()[0]
    return rows.filter(F.col("u") <= F.lit(cut_off)).limit(max_docs)


def _findings(rows: DataFrame, seed: int) -> DataFrame:
    """Windows of every row's base findings (label 1), and of six generated ones: u and at (which finding), x (the window), y
    (its label), made (whether it was generated), part (its part of the finding's weight) and text (the row's mark)."""

    def each(text: str, u: float) -> Iterator[tuple]:
        for s in base_spans(text):
            of = windows(text, s)
            yield from ((s[0], w.tobytes(), 1, False, max(1, WHOLE // len(of))) for w in of)
        rng = random.Random(f"{seed}:{u}")
        at = rng.randint(0, max(0, len(text) - 80))
        for k, (t, s, y) in enumerate(_generated(rng, text[at : at + 80])):
            of = windows(t, s)
            yield from ((-1 - k, w.tobytes(), y, True, WHOLE // len(of)) for w in of)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = ((u, *f, mark) for u, text, mark in zip(pdf["u"], pdf["text"], pdf["mark"], strict=True) for f in each(text or "", u))
            for some in batched(found, 20_000):
                yield pd.DataFrame(some, columns=["u", "at", "x", "y", "made", "part", "text"])

    return rows.select("u", "text", "mark").mapInPandas(cut, "u double, at long, x binary, y int, made boolean, part long, text long")


def labelled_findings(docs: DataFrame, max_docs: int, seed: int = 7) -> pd.DataFrame:
    """The windows that training would see of at most max_docs documents, to look at; trained() itself collects none."""
    return _findings(_least(_rows(docs, seed), max_docs), seed).toPandas().sort_values(["u", "at", "x"], ignore_index=True)


def split(text: np.ndarray) -> np.ndarray:
    """Which findings are held out: all of a document's, and of its copies', or none. Of findings at hand, as sides() says."""
    held = np.array([zlib.crc32(f"held {t}".encode()) % 10 < 3 for t in text.tolist()], bool)
    if held.any() and not held.all():
        return held
    distinct = np.unique(text)
    return np.isin(text, distinct[: len(distinct) // 3])


def sides(rows: DataFrame) -> Column | None:
    """Whether findings of a text (by its hash) are held out: three in ten texts, or a third of them if that leaves a side
    empty; None if a side is empty even so."""
    held = F.crc32(F.concat(F.lit("held "), F.col("text").cast("string")).cast("binary")) % 10 < 3
    marks = rows.select(F.col("mark").alias("text"))
    least, most = marks.agg(F.min(held), F.max(held)).first()
    if least != most:
        return held
    distinct = marks.distinct()
    last = distinct.orderBy("text").limit(distinct.count() // 3).agg(F.max("text")).first()[0]
    return None if last is None else F.col("text") <= last


def trained(docs: DataFrame, recall: float = 0.985, max_docs: int | None = None, seed: int = 7) -> CharNet | None:
    """The network fitted on labelled findings of all docs (of at most max_docs if a caller asks for fewer); None if there is
    nothing to learn from, or nothing to hold out.

    A round trains groups of one share of the windows, side by side and each from the same weights; their mean, by number
    of windows, is where the next round starts. Every window takes part in a round, and in several if there are fewer
    groups than rounds. What is gathered are weights and counts of rounded logits, which do not grow with docs.
    """
    rows = _rows(docs, seed)
    rows = rows if max_docs is None else _least(rows, max_docs)
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    held = sides(rows) if n else None
    if held is None:
        return None
    groups = -(-max(n * GROUP_BYTES, (size or 0) * GROUP_DOCS) // (GROUP_DOCS * GROUP_BYTES))
    shares = min(ROUNDS, groups)
    found = _findings(rows, seed).select("x", "y", "made", "part", held.alias("held"))
    # a window that copies have in common is learned from once
    found = found.groupBy("x", "y", "made", "held").agg(F.max("part").alias("part"))
    group = F.pmod(F.xxhash64("x"), F.lit(groups))
    since = made()
    kept = stored(found.select("x", "y", "made", "part", group.alias("g"), F.when(F.col("held"), -1).otherwise(F.pmod(group, F.lit(shares))).cast("int").alias("share")), "findings", by="share")
    net = CharNet(seed)
    for turn in range(shares * -(-ROUNDS // shares)):
        share = turn % shares
        _train_groups(net, kept.filter(F.col("share") == share).repartition(4 * -(-(groups - share) // shares), "g"), seed + turn)
    _calibrate_all(net, kept.filter("share = -1").repartition(-(-groups // 4), "x"), recall)
    clear(docs.sparkSession, since)
    return net


def _train_groups(net: CharNet, found: DataFrame, seed: int) -> None:
    """Sets net's weights to the mean of those that each group (g) of found comes to from them."""
    start = {k: a.copy() for k, a in net.weights.items()}

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "made"])
        own = CharNet(seed, weights=dict(start))
        own.train(_stack(pdf["x"]), pdf["y"].to_numpy(float), epochs=1, part=pdf["part"].to_numpy(float))
        flat = np.concatenate([a.ravel() for a in own.weights.values()])
        return pd.DataFrame({"at": np.arange(len(flat)), "w": np.rint(flat * len(pdf) * WHOLE).astype(np.int64), "n": len(pdf)})

    got = found.groupBy("g").applyInPandas(learn, "at int, w long, n long").groupBy("at").agg(F.sum("w"), F.sum("n")).collect()
    if got:
        flat, at = np.array([w / n / WHOLE for _, w, n in sorted(got)]), 0
        for k, a in start.items():
            net.weights[k] = flat[at : at + a.size].reshape(a.shape)
            at += a.size


def _calibrate_all(net: CharNet, found: DataFrame, recall: float) -> None:
    """net.calibrate on all of found, by how often each rounded logit comes."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"z": net.logits(_stack(pdf["x"])), "y": pdf["y"], "made": pdf["made"], "part": pdf["part"]})

    got = found.mapInPandas(score, "z double, y int, made boolean, part long").groupBy("z", "y", "made").agg(F.sum("part").alias("n")).toPandas().sort_values(["z", "y", "made"])
    net.calibrate_counted(got["z"].to_numpy(), got["y"].to_numpy(float), got["n"].to_numpy(float) / WHOLE, recall, got["made"].to_numpy(bool))


def _stack(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, WIDTH)


def find_secrets(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """Finds secrets in the whole text of each row of docs (doc_id, text); trains a network on docs if none is given.

    Returns doc_id, n_assign, n_access, n_hex, n_token, n_spans, base_sha256, spans (base and added ones), scores
    (kind:start:calibrated score of every candidate, base ones included). Offsets are code points, ends exclusive. Null
    and empty texts have none; a long text, and a long candidate in it, is read whole; repeated rows and null doc_id pass
    through, one output row for each input row; an empty table gives no rows and nothing is learned from it; other
    columns are ignored.
    """
    net = net or trained(docs)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_token long, n_spans long, base_sha256 string, spans string, scores string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            base = [base_spans(t) for t in texts]
            every = [b + candidates(t, b) for t, b in zip(texts, base, strict=True)]
            x = [windows(t, s) for t, found in zip(texts, every, strict=True) for s in found]
            score = iter(net.best(x) if net else np.zeros(len(x)))
            out = []
            for i, b, found in zip(pdf["doc_id"].astype("Int64"), base, every, strict=True):
                scored = [(s, next(score)) for s in found]
                more = [s for s, v in scored[len(b) :] if net and v >= net.threshold]
                counts = [sum(s[2] == k for s in b) for k in BASE]
                out.append((i, *counts, len(more), len(b) + len(more), digest(joined(b, KINDS)), joined(b + more, KINDS), ",".join(f"{s[2]}:{s[0]}:{v:.4f}" for s, v in sorted(scored))))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInPandas(run, schema)
