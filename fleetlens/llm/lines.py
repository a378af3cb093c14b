"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is the sequence of its words. The edit bound is one word inserted, deleted or replaced for lines of at least
MIN_WORDS words, and none for shorter ones, where one word is a large part of the line: those are alike only if equal.
1. Equal lines, of any number of words, collapse to a class with its earliest place (map-side combined, so a frequent
   line is one row).
2. Two lines within one edit agree in their first or in their last p words, p at most half of them. Only
   classes that share such a head or tail with another one go on; this loses no alike pair and spares most lines the
   next step.
3. Those emit every variant with one word deleted, as a hashed key with the place of the deletion. Lines with equal
   key and place differ in that word; a line whose own key equals another's variant lacks that word. Each line asks
   for the earliest such line: minimum aggregates and joins on keys, no pairs within a group.
4. The edit distance is verified on the words; a line that has an earlier alike line goes.

Frequent keys (lines, heads, variants) are joined by broadcast of a bounded number of them (common.join_counted).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import SPACE_CLASS, join_counted, join_wide, private, stored

ORD = "decimal(38,0)"
MIN_WORDS = 6
#: The last words of a text with a null doc_id are ordered behind all others.
_NO_ID = str(2**63)


def _order(doc: Column, line: Column) -> Column:
    """One number that orders places by doc_id and then line."""
    return (F.coalesce(doc.cast("decimal(20,0)"), F.lit(_NO_ID).cast("decimal(20,0)")) * F.lit(2**31).cast("decimal(11,0)") + line.cast("decimal(11,0)")).cast(ORD)


def _plain(body: Column) -> Column:
    """The line with one space between words and none around them; most lines are so already."""
    odd = reduce(lambda a, b: a | b, (body.contains(c) for c in ("  ", "\t", "\x0b", "\f", "\r")))
    return F.trim(F.when(odd, F.regexp_replace(body, f"[{SPACE_CLASS}]+", " ")).otherwise(body))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))


def _once(*columns: Column) -> Column:
    """A generator of one row: the columns are computed once, however often what follows uses them."""
    return F.inline(F.array(F.struct(*columns)))


_WORDS = "cast(octet_length(plain) - octet_length(replace(plain, ' ', '')) + 1 AS int)"


def _half(words: str) -> str:
    """Half of the words, rounded down to three binary digits."""
    return f"CAST({words} div 2 - ({words} div 2) % shiftleft(1, greatest(0, CAST(log2({words} div 2) AS INT) - 2)) AS INT)"


def _shared_ends() -> Column:
    """Hashes of a line's head and tail (column plain) of p words, p its half.

    A line has those of the half of a line one word shorter as well (p_less), if that is another; short lines have none.
    """
    ends = [f"xxhash64(0, {p}, substring_index(plain, ' ', {p})), xxhash64(1, {p}, substring_index(plain, ' ', -{p}))" for p in ("p", "p_less")]
    return F.expr(f"CASE WHEN words < {MIN_WORDS} THEN NULL WHEN words > {MIN_WORDS} AND p <> p_less THEN array({ends[0]}, {ends[1]}) ELSE array({ends[0]}) END")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), exact and near: sorted numbers (from 0) of the lines that have an earlier equal or alike line.

    Only documents that have such lines are in the result. Lines without words are left alone.
    """
    place = _order(F.col("doc_id"), F.col("line"))
    lines = _keyed(docs).select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    lines = lines.select("doc_id", "mark", "line", _once(_plain(F.col("body")).alias("plain"), place.alias("ord"))).filter("plain <> ''")
    lines = lines.select("doc_id", "mark", "line", "ord", "plain", _once(F.expr(_WORDS).alias("words")))
    lines = lines.select("doc_id", "mark", "line", "ord", "plain", "words", _once(F.expr(_half("greatest(words, 2)")).alias("p"), F.expr(_half("greatest(words - 1, 2)")).alias("p_less")))
    lines = lines.select("doc_id", "mark", "line", "ord", "plain", F.explode(F.array(_shared_ends())).alias("ends"))
    # lines as narrow rows: two independent hashes stand for the words
    lines = stored(lines.select("doc_id", "mark", "line", "ord", F.xxhash64("plain").alias("h"), F.hash("plain").alias("h2"), *[F.get("ends", F.lit(k)).alias(f"e{k}") for k in range(4)]), "lines")
    classes = stored(lines.groupBy("h", "h2").agg(F.min("ord").alias("ord"), F.min_by("mark", "ord").alias("mark"), F.count("*").alias("n"), *[F.first(f"e{k}").alias(f"e{k}") for k in range(4)]), "line-classes")
    ends = classes.select("h", F.explode(F.array_compact(F.array("e0", "e1", "e2", "e3"))).alias("end"))
    met = stored(ends.groupBy("end").agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b"), "line-ends-met")
    # two classes with one end are known from the aggregate; of more, each asks
    pairs = met.filter("n = 2").select(F.explode(F.array("a", "b")).alias("h"))
    going = pairs.union(join_counted(ends, stored(met.filter("n > 2").select("end", "n"), "line-ends-often"), ["end"]).select("h")).distinct()
    asked = classes.join(going, "h").select(F.expr("cast(ord div 2147483648 AS decimal(20,0))").alias("id"), F.expr("cast(ord - cast(ord div 2147483648 AS decimal(20,0)) * 2147483648 AS int)").alias("line"), "mark", "h", "h2", "ord", "n")
    asked = asked.withColumn("id", F.when(F.col("id") < F.lit(_NO_ID).cast("decimal(20,0)"), F.col("id")).cast("long"))
    asked = asked.groupBy("id", "mark").agg(F.collect_list(F.struct("line", "h", "h2", "ord", "n")).alias("asked"))
    keyed = _keyed(docs)
    # the words of one line for each class, from the document that has it first; ids in the order of the places
    found = (
        keyed.join(asked.hint("shuffle_hash"), (keyed["mark"] == asked["mark"]) & keyed["doc_id"].eqNullSafe(asked["id"]))
        .select(F.split("text", "\n").alias("lines"), F.explode("asked").alias("x"))
        .select("x.*", _once(_plain(F.coalesce(F.get("lines", F.col("x.line")), F.lit(""))).alias("plain")))
        .filter((F.xxhash64("plain") == F.col("h")) & (F.hash("plain") == F.col("h2")))
        .dropDuplicates(["h", "h2"])
    )
    bodies = stored(found.select("h", "h2", "ord", "n", "plain").orderBy("ord", "h", "h2").withColumn("id", F.monotonically_increasing_id()), "line-words")
    places = bodies.select("id", "plain", F.expr(_WORDS).alias("words")).select("id", "plain", "words", F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("gap"))
    rest = "trim(concat(substring_index(plain, ' ', gap), ' ', substring_index(plain, ' ', gap + 1 - words)))"
    cuts = stored(places.select("id", F.expr(f"xxhash64({rest})").alias("v"), "gap"), "line-variants")
    lowest = stored(cuts.groupBy("v", "gap").agg(F.min("id").alias("to"), F.max("id").alias("last"), F.count("*").alias("n")), "line-variants-first")
    # one word replaced: equal key and place; the earliest stands for all before
    two = lowest.filter("n = 2 AND to < last").select(F.col("last").alias("id"), "to")
    more = join_counted(cuts, stored(lowest.filter("n > 2").drop("last"), "line-variants-often"), ["v", "gap"]).select("id", "to")
    # one word more or less: a variant is another's whole line
    whole = bodies.groupBy(F.col("h").alias("v")).agg(F.min("id").alias("own"))
    met = stored(lowest.join(whole, "v").groupBy("v", "own").agg(F.min("to").alias("first"), F.sum("n").alias("n")), "line-variants-whole")
    shorter = met.select(F.col("own").alias("id"), F.col("first").alias("to"))
    longer = join_counted(cuts, met.select("v", F.col("own").alias("to"), "n"), ["v"]).select("id", "to")
    candidates = two.union(more).union(shorter).union(longer).filter("to < id").distinct()
    # verify: at most one word inserted, deleted or replaced
    words = bodies.select("id", F.split("plain", " ").alias("words"))
    a, b = F.col("words"), F.col("other")
    common = F.least(F.size(a), F.size(b))
    ahead = F.coalesce(F.array_min(F.filter(F.transform(F.sequence(F.lit(0), common - 1), lambda i: F.when(F.get(a, i) != F.get(b, i), i)), lambda i: i.isNotNull())), common)
    tail = lambda x, i: F.slice(x, i + 1, F.greatest(F.size(x) - i, F.lit(0)))
    i = F.col("i")
    one = F.when(F.size(a) == F.size(b), tail(a, i + 1) == tail(b, i + 1)).when(F.size(a) == F.size(b) + 1, tail(a, i + 1) == tail(b, i)).when(F.size(b) == F.size(a) + 1, tail(a, i) == tail(b, i + 1)).otherwise(False)
    pairs = stored(candidates, "line-pairs")
    others = words.select(F.col("id").alias("to"), F.col("words").alias("other"))
    near = join_wide(pairs, others, "to", "id").join(words, "id").withColumn("i", ahead).filter(one).select("id").distinct()
    near = bodies.join(near, "id").select("h", "h2", "ord", "n", F.lit(True).alias("near"))
    marks = stored(classes.filter("n > 1").select("h", "h2", "ord", "n", F.lit(False).alias("near")).union(near).groupBy("h", "h2").agg(F.min("ord").alias("ord"), F.max("n").alias("n"), F.max("near").alias("near")), "line-marks")
    judged = join_counted(lines.select("doc_id", "mark", "line", F.col("ord").alias("own"), "h", "h2"), marks, ["h", "h2"])
    later = F.col("own") > F.col("ord")
    return (
        judged.filter(later | F.col("near"))
        .groupBy("doc_id", "mark")
        .agg(F.sort_array(F.collect_set(F.when(later, F.col("line")))).alias("exact"), F.sort_array(F.collect_set(F.when(~later, F.col("line")))).alias("near"))
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) with repeated lines taken out of text, plus n_lines, n_exact, n_near.

    Every row stays, in any order; earliest is by doc_id, then line. Null text stays null with 0 lines; empty text has
    one line, which is kept; a null doc_id comes last; rows that are equal in doc_id and text count as one document and
    lose the same lines; a line may repeat inside its document; an empty table gives no rows; work is linear in
    the number of lines, and for each line of six words or more grows with the square of its words. Columns of docs named like those added are replaced, all others pass through whatever their names.
    A line that has a word goes if an earlier one is equal or within the edit bound (see above) in the input, whether
    that one stays or not.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    doc, mark, exact, near = (private(x) for x in ("doc", "mark", "exact", "near"))
    gone = repeated_lines(docs.select("doc_id", "text")).select(F.col("doc_id").alias(doc), F.col("mark").alias(mark), F.col("exact").alias(exact), F.col("near").alias(near))
    both = docs.select(*[F.col(f"`{c}`") for c in own]).join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(mark)), "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.concat(exact, near))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return both.select(
        *[F.when(F.col(mark).isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(f"`{c}`") for c in own],
        F.expr("CASE WHEN text IS NULL THEN 0 ELSE octet_length(text) - octet_length(replace(text, '\n', '')) + 1 END").cast("long").alias("n_lines"),
        F.coalesce(F.size(exact), F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce(F.size(near), F.lit(0)).cast("long").alias("n_near"),
    )
