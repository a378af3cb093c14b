"""Quality rules as a learned decision list, in DataFrame and SQL functions only.

Statistics of a text are Spark expressions. From labelled documents, sequential covering grows conjunctions of
thresholds (each step one grouped count over binned statistics), prunes them on held-out rows, and stops when a rule
is no longer precise there. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import SPACE_CHARS, private, stored, trimmed, uniform, words

# The symbols counted as such, and the base rule's limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits")

#: What rules may test. All are ratios or means, so that they mean the same for short and long texts.
FEATURES = {
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "chars_per_word": lambda: _ratio("word_chars", "n_words"),
    "repeat_share": lambda: _ratio("n_repeat_words", "n_words"),
    "dup_line_share": lambda: _ratio("n_dup_lines", "n_lines"),
    "upper_share": lambda: _ratio("n_upper", "word_chars"),
    "marks_per_word": lambda: _ratio("n_marks", "n_words"),
    "digit_share": lambda: _ratio("n_digits", "word_chars"),
}


#: Helper columns stand beside the caller's own.
_WORDS, _LINES, _BODY, _WINDOWS, _PLACED, _AT = (private(x) for x in ("words", "lines", "body", "windows", "placed", "at"))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double")).otherwise(F.lit(0.0))


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs (with text) plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and a few more counts.

    Null text counts as no text: every count 0. Work per text is linear but for one sort of a repetitive text's
    windows. Windows of three words are compared by a 64-bit hash within their text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    step = docs.withColumns({_WORDS: words(text), _LINES: lines, _BODY: trimmed(text)})
    n = F.size(_WORDS)
    window = lambda i: F.xxhash64(F.get(_WORDS, i), F.get(_WORDS, i + 1), F.get(_WORDS, i + 2))
    none = F.array().cast("array<bigint>")
    step = step.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
            "n_symbols": _count_of(text, SYMBOLS),
            "n_lines": F.size(_LINES).cast("long"),
            "n_dup_lines": (F.size(_LINES) - F.size(F.array_distinct(_LINES))).cast("long"),
            "n_upper": (F.length(_BODY) - F.length(F.regexp_replace(_BODY, r"\p{Lu}", ""))).cast("long"),
            "n_marks": _count_of(text, "!?"),
            "n_digits": _count_of(text, "0123456789"),
            _WINDOWS: F.when(n < 3, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)),
        }
    ).drop(_WORDS, _LINES, _BODY)
    # windows found twice or more, as sorted positions; skipped when all differ
    placed = F.array_sort(F.transform(_WINDOWS, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn(_PLACED, F.when(F.size(F.array_distinct(_WINDOWS)) < F.size(_WINDOWS), placed)).drop(_WINDOWS)
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = F.filter(_PLACED, lambda x, j: same(x, F.get(_PLACED, j + 1)) | ((j > 0) & same(x, F.get(_PLACED, F.greatest(j - 1, F.lit(0))))))
    step = step.withColumn(_AT, F.array_sort(F.transform(twice, lambda x: x["i"]))).drop(_PLACED)
    # every window covers three words; overlapping windows cover the gap between their starts
    gaps = F.aggregate(F.zip_with(F.slice(_AT, 2, F.greatest(F.size(_AT), F.lit(1))), F.slice(_AT, 1, F.greatest(F.size(_AT) - 1, F.lit(0))), lambda b, a: F.least(F.lit(3), b - a)), F.lit(0), lambda s, x: s + x)
    step = step.withColumn("n_repeat_words", F.when(F.coalesce(F.size(_AT), F.lit(0)) > 0, gaps + 3).otherwise(F.lit(0)).cast("long"))
    # a generator of one row: filters on the statistics stay above it instead of being inlined into these expressions
    return step.select(*[F.col(f"`{c}`") for c in docs.columns if c not in STATISTICS], F.inline(F.array(F.struct(*STATISTICS))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = FEATURES[self.feature]()
        return f > self.threshold if self.above else f <= self.threshold


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (t.column() for t in self.tests))

    def name(self) -> str:
        return " and ".join(f"{t.feature} {'>' if t.above else '<='} {t.threshold:.6g}" for t in self.tests)


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the name of the first rule that rejects the text, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(rule.name())).otherwise(out)
    return out


def _best(cells: dict[tuple[str, int], tuple[int, int]], cuts: dict[str, list[float]], bad: int, good: int) -> tuple[float, Test | None]:
    """The test with the greatest FOIL gain, from counts of bad and good rows by (feature, bin)."""
    best: tuple[float, Test | None] = (1e-9, None)
    start = math.log2((bad + 1) / (bad + good + 2))
    for feature, at in cuts.items():
        p = n = 0
        for k, threshold in enumerate(at):
            x, y = cells.get((feature, k), (0, 0))
            p, n = p + x, n + y
            for above, pp, nn in ((False, p, n), (True, bad - p, good - n)):
                gain = pp * (math.log2((pp + 1) / (pp + nn + 2)) - start)
                if gain > best[0]:
                    best = gain, Test(feature, above, threshold)
    return best


def learn_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, bins: int = 24, max_rules: int = 12, max_tests: int = 3, precision: float = 0.97, seed: int = 8) -> list[Rule]:
    """Learns rules that reject documents labelled quality 0.

    docs: doc_id, text. labels: doc_id, quality. At most about max_labelled labelled documents, chosen by a hash of
    doc_id, are used; two thirds grow rules and one third prunes and judges them. Rows with null ids, labels or
    documents that are missing are ignored; repeated labels of an id count once (the worst one); with one class only,
    or no labels, there are no rules. A rule stays if its precision on the judging third is at least `precision`; the
    growing rows of one that does not are set aside, and the search goes on. It ends when no bad row is left, no test
    gains anything, or max_rules rules stay (or twice as many were tried).
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("_quality"))
    total = known.count()
    if not total:
        return []
    known = known.filter(uniform("doc_id", seed=seed) < max_labelled / total)
    # the sample's ids are at most about max_labelled longs, which bounds the broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = with_statistics(rows).select((F.col("_quality") < 1).alias("bad"), (uniform("doc_id", seed=seed + 1) < 2 / 3).alias("grow"), "n_words", "n_repeat_words", *[f().alias(k) for k, f in FEATURES.items()])
    # what the base rule rejects needs no other
    rows = stored(rows.filter(~base_failed()).drop("n_words", "n_repeat_words"), "quality-sample")
    plain = lambda t: F.col(t.feature) > t.threshold if t.above else F.col(t.feature) <= t.threshold
    quantiles = [k / bins for k in range(1, bins)]
    # thresholds from the bad and from the good rows, so that a rare kind of junk has its own
    found = rows.filter("grow").groupBy("bad").agg(*[F.percentile_approx(c, quantiles, 1000).alias(c) for c in FEATURES]).collect()
    if len(found) < 2:
        return []
    cuts = {c: sorted({x for r in found for x in r[c]}) for c in FEATURES}
    bin_of = lambda c: F.size(F.filter(F.lit(cuts[c]).cast("array<double>"), lambda t: t < F.col(c)))
    binned = stored(rows.withColumns({f"_{c}": bin_of(c) for c in FEATURES}), "quality-bins")
    rules: list[Rule] = []
    left = binned
    for _ in range(2 * max_rules):
        if len(rules) == max_rules:
            break
        tests: list[Test] = []
        inside = left.filter("grow")
        while len(tests) < max_tests:
            long = inside.select("bad", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"_{c}").alias("k")) for c in FEATURES])).alias("x"))
            cells = {(r["f"], r["k"]): (r["p"], r["n"]) for r in long.groupBy("x.f", "x.k").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()}
            one = next(iter(FEATURES))
            bad, good = (sum(v[k] for (f, _), v in cells.items() if f == one) for k in (0, 1))
            if not bad or (tests and not good):
                break
            test = _best(cells, cuts, bad, good)[1]
            if test is None:
                break
            # put the threshold in the middle of the gap that it falls into
            f = F.col(test.feature)
            gap = inside.agg(F.max(F.when(f <= test.threshold, f)).alias("a"), F.min(F.when(f > test.threshold, f)).alias("b")).first()
            if gap["a"] is not None and gap["b"] is not None:
                test = Test(test.feature, test.above, (gap["a"] + gap["b"]) / 2)
            tests.append(test)
            inside = inside.filter(plain(test))
        if not tests:
            break
        # prune: the prefix of the conjunction that does best on the other third
        held = left.filter("NOT grow")
        heads = [reduce(lambda a, b: a & b, map(plain, tests[: k + 1])) for k in range(len(tests))]
        got = held.agg(*[F.count_if(h & F.col("bad")).alias(f"p{k}") for k, h in enumerate(heads)], *[F.count_if(h & ~F.col("bad")).alias(f"n{k}") for k, h in enumerate(heads)]).first()
        worth = [((got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"]), got[f"p{k}"], -k) for k in range(len(tests))]
        k = -max(worth)[2]
        p, n = got[f"p{k}"], got[f"n{k}"]
        if p < 3 or p < precision * (p + n):
            left = left.filter(~(F.col("grow") & heads[-1]))
            continue
        rules.append(Rule(tuple(tests[: k + 1])))
        left = left.filter(~heads[k])
    return rules


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs plus statistics, base_failed, rejected_by (base, a rule's name, or null) and kept.

    Every input row gets one output row, repeated rows and null texts (no words: base_failed) included; an empty table
    gives no rows; columns of docs with a name that this adds are replaced, all others pass through.
    """
    docs = docs.drop("base_failed", "rejected_by", "kept")
    out = with_statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(verdict(rules))).withColumn("kept", F.col("rejected_by").isNull())
