"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import SPACE_CHARS, clear, documents, made, stored
from fleetlens.llm.lines import dedup_lines
from fleetlens.llm.mixing import take
from fleetlens.llm.neardup import keep_one
from fleetlens.llm.packing import pack
from fleetlens.llm.quality import judged, learn_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """df's rows with the columns of documents; n_chars follows the text."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects.

    A null, empty or blank text has no words and goes; repeated rows are judged each, so both stay or both go; a null
    doc_id is judged like any; a long text is read whole; an empty table gives no rows; other columns are left out.
    """
    rules = learn_rules(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs.select(*COLUMNS), rules).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier (by doc_id, then line); those that lost all their words go.

    Null and empty texts stay as they are; rows equal in doc_id and text count as one document and lose the same lines;
    a null doc_id comes last; a long text is read whole; an empty table gives no rows; other columns are left out.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    blank = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACE_CHARS)) == ""
    return _documents(out.filter(~(blank & (F.col("n_exact") + F.col("n_near") > 0))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near-duplicates.

    A document is a doc_id with its text: unlike texts of one doc_id, or without any, are judged each; rows equal in
    both stay once; ties go by a hash of the text. Texts without words are linked with nothing and stay; a long text is
    read whole; an empty table gives no rows; other columns are left out.
    """
    return keep_one(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or up to three times.

    Texts without words are never taken; rows equal in doc_id and text are taken as often as all of them together; a
    null source is a source, the last; ties go by size and doc_id; a long text is one document; an empty table gives no
    rows; other columns are left out.
    """
    return take(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048; every row of docs is packed, repeated ones each.

    A null or empty text is the end token alone; a long text is cut into as many pieces as it needs; a null doc_id is
    kept; an empty table gives no rows.
    """
    return pack(docs.select("doc_id", "text"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("packing", packing)]

#: Learned rules, uniform numbers by hash and tokenization are not SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again; what a stage wrote besides is deleted."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before = made()
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, before, last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
