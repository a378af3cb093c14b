"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Targets fill up by weight until each source is at its target or at its cap (water filling). Inside a source every
document has an expected number of copies; its whole part is allocated as certain copies, and the fraction is the
inclusion probability p of one more. Documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a uniform number fixed by
the document, and the lowest ranks are taken until the source's remaining words are used up; of the rest, the one
document that comes nearest to the words still missing is taken too.

No source is ever sorted or gathered whole: the logarithms of the ranks are binned, bins are summed with map-side
combine, and only the one bin of each source in which the cut falls is ordered. A document's log rank spreads at least
as the logistic distribution whatever its p, so a bin holds at most a part 1 / (4 * BINS) of a source's documents.

The one document that closes the gap is not drawn by its odds: of a source's n ranked documents it changes one, so that
an inclusion probability is off by at most 1/n. Without it a source misses its target by up to a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import MIN_LONG, private, stored, uniform, word_count

#: More sources than this are joined by shuffle instead of broadcast (about 100 bytes each).
BROADCAST_SOURCES = 20_000
#: Bins for one unit of a rank's logarithm.
BINS = 256


def water_level(items: DataFrame, by: list[str], weight: str, cap: str, total: Column) -> DataFrame:
    """items with column level: the least multiple of weight so that sum(min(cap, level * weight)) is total, per `by`.

    Items are aggregates (sources, or weight classes of a source). With all caps below total the level is infinite.
    """
    ratio = F.col(cap) / F.col(weight)
    order = Window.partitionBy(*by).orderBy(F.col("_ratio"), F.col(weight))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    tried = (
        items.withColumn("_ratio", ratio)
        .withColumn("_full", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("_open", F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
        .withColumn("_try", (total - F.col("_full")) / F.col("_open"))
    )
    # tries fall from the first valid one on, so the greatest valid one is the level
    level = F.max(F.when(F.col("_try") <= F.col("_ratio"), F.col("_try"))).over(whole)
    return tried.withColumn("level", F.coalesce(level, F.lit(float("inf")))).drop("_ratio", "_full", "_open", "_try")


def take(docs: DataFrame, **how) -> DataFrame:
    """docs' rows as often as pareto_mix takes them; columns unchanged, whatever their names.

    Rows that are equal in doc_id and text are taken as often as all of them together; a null doc_id is an id like
    another; documents without words are never taken; an empty table gives no rows.
    """
    doc, mark, copies = private("doc"), private("mark"), private("copies")
    taken = pareto_mix(docs.select("doc_id", "text", "source"), **how)
    taken = taken.groupBy(F.coalesce("doc_id", F.lit(MIN_LONG)).alias(doc), F.col("mark").alias(mark)).agg(F.sum("copies").cast("int").alias(copies)).filter(F.col(copies) > 0)
    once = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)).alias(doc), F.xxhash64("text").alias(mark)).dropDuplicates([doc, mark])
    return once.join(taken, [doc, mark]).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).drop(copies)


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 9, classes: int = 32) -> DataFrame:
    """Decides for each row of docs (doc_id, text, source) how many copies the mix takes.

    Sources in code-point order, null last, weigh `weights` in turn and share all words; no source's target exceeds
    cap times its words. Expected copies rise mildly with length (weight 0.5 to 1.5 in `classes` steps: fragments are
    less worth repeating) and are scaled so that they meet the source's target; never over cap.
    Returns doc_id, source, size (words), source_size, target, copies, taken (copies * size) and mark (a hash of the
    text); one row per input row.
    Null text has size 0; documents without words are never taken; repeated rows are separate documents with ties
    broken by size; an empty table gives no rows; other columns are ignored.
    """
    text = F.col("text")
    narrow = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64("text").alias("_t"), F.monotonically_increasing_id().alias("_tie")), "mix-sizes")
    # Documents of one source fall in few length classes: all that follows works on these sums.
    step = F.round(F.lit(float(classes)) * (F.lit(0.5) + F.col("size") / (F.col("size") + F.lit(100.0)))) / F.lit(float(classes))
    narrow = narrow.withColumn("_w", step).withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")))
    sums = stored(narrow.groupBy("_s", "_w").agg(F.sum("size").alias("_words")), "mix-sums")
    ranked = F.row_number().over(Window.orderBy("_s"))
    picked = F.element_at(F.lit([float(w) for w in weights]), (F.pmod(ranked - 1, F.lit(len(weights))) + 1).cast("int"))
    # one row per source: a global order over sources, not over documents
    sources = sums.groupBy("_s").agg(F.sum("_words").alias("source_size")).withColumn("_weight", picked).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    total = sums.agg(F.coalesce(F.sum("_words"), F.lit(0)).cast("double").alias("t")).first()["t"]
    sources = water_level(sources, [], "_weight", "_cap", F.lit(total)).withColumn("target", F.least("_cap", F.col("level") * F.col("_weight"))).select("_s", "source_size", "target")
    per_class = sums.filter("_words > 0").join(sources, "_s").withColumn("_weight", F.col("_w") * F.col("_words")).withColumn("_cap", F.col("_words") * F.lit(float(cap)))
    share = (
        water_level(per_class, ["_s"], "_weight", "_cap", F.col("target"))
        .withColumn("_copies", F.least(F.lit(float(cap)), F.col("level") * F.col("_w")))
        .withColumn("_sure", F.least(F.lit(cap), F.floor(F.col("_copies") + F.lit(1e-9))).cast("int"))
        .withColumn("_p", F.greatest(F.lit(0.0), F.col("_copies") - F.col("_sure")))
        .withColumn("_p", F.when(F.col("_p") < 1e-9, 0.0).otherwise(F.col("_p")))
        .withColumn("_rest", F.col("target") - F.sum(F.col("_sure") * F.col("_words")).over(Window.partitionBy("_s")))
        .select("_s", "_w", "_sure", "_p", "_rest")
    )
    # classes without words (empty texts) are not in the filling, but keep their source's figures
    share = sums.select("_s", "_w").join(sources, "_s").join(share, ["_s", "_w"], "left")
    known = share.count() <= BROADCAST_SOURCES * classes // 8
    hint = F.broadcast if known else (lambda x: x)
    u = uniform("doc_id", "_t", seed=seed)
    odds = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
    dealt = narrow.join(hint(share), ["_s", "_w"]).withColumn("_q", F.when(F.col("_p") > 0, odds)).withColumn("_bin", F.when(F.col("_q").isNotNull(), F.floor(F.ln("_q") * BINS).cast("int")))

    bins = dealt.filter("_bin IS NOT NULL").groupBy("_s", "_bin").agg(F.sum("size").alias("_n"), F.first("_rest").alias("_rest"))
    run = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        bins.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
        .filter("_before < _rest AND _before + _n >= _rest")
        .select("_s", F.col("_bin").alias("_cut"), "_before")
    )
    dealt = dealt.join(hint(cut), "_s", "left")
    # Whole bins below the cut are taken; with no cut (all ranked words fit) every ranked document is.
    edge = dealt.filter("_bin = _cut")
    upto = Window.partitionBy("_s").orderBy("_q", F.col("size").desc(), F.coalesce("doc_id", F.lit(MIN_LONG)), "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("_more", (F.col("_before") + F.sum("size").over(upto) <= F.col("_rest")).cast("int"))
    rest = dealt.filter("_bin IS NULL OR _cut IS NULL OR _bin <> _cut").withColumn("_more", F.coalesce((F.col("_bin").isNotNull() & (F.col("_rest") > 0) & (F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut")))).cast("int"), F.lit(0)))
    whole = stored(rest.unionByName(edge), "mix-ranked")
    # what the last document would overshoot is filled by the one document left over that comes nearest to it
    gaps = whole.filter("_cut IS NOT NULL").groupBy("_s").agg((F.first("_rest") - F.sum(F.when(F.col("_bin").isNotNull(), F.col("_more") * F.col("size")).otherwise(0))).alias("_gap"))
    miss = F.abs(F.col("size") - F.col("_gap"))
    last = whole.filter("_bin IS NOT NULL AND _more = 0 AND size > 0").join(hint(gaps), "_s").filter(miss < F.col("_gap")).groupBy("_s").agg(F.min(F.struct(miss.alias("miss"), "_q", F.coalesce("doc_id", F.lit(MIN_LONG)).alias("id"), "_tie")).alias("_l")).select("_s", F.col("_l._tie").alias("_last"))
    whole = whole.join(hint(last), "_s", "left").withColumn("_more", F.when(F.col("_tie").eqNullSafe(F.col("_last")), F.lit(1)).otherwise(F.col("_more")))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.coalesce("_sure", F.lit(0)) + F.col("_more"))
    return whole.select(
        "doc_id",
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        F.col("_t").alias("mark"),
    )
