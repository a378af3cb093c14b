"""One registered query for each operator; each applies it to the whole of `documents`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import oracles
from fleetlens.llm.alignment import align
from fleetlens.llm.audio import features
from fleetlens.llm.common import documents
from fleetlens.llm.lines import dedup_lines
from fleetlens.llm.lm import katz_scores
from fleetlens.llm.mixing import pareto_mix
from fleetlens.llm.neardup import near_duplicates
from fleetlens.llm.packing import pack
from fleetlens.llm.pii import find_pii
from fleetlens.llm.quality import judged, learn_rules
from fleetlens.llm.secrets import find_secrets
from fleetlens.llm.sharding import shard_by_bytes
from fleetlens.llm.substrings import remove_repeats
from fleetlens.llm.trie import prefix_trie


def op1_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(documents(spark, sf_dir).select("doc_id", "text"), keep=())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir).select("doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir).select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    # the kept text is put together once, for its size and for its hash
    out = out.select("doc_id", "n_lines", "n_exact", "n_near", F.explode(F.array(F.coalesce("text", F.lit("")))).alias("kept"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.octet_length("kept").cast("long").alias("kept_bytes"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text")).selectExpr("doc_id", "start", "cast(length AS long) AS length", "ids_crc32", "doc_tokens", "sequence_id", "cast(offset AS long) AS offset")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir).select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))


def op11_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir).select("doc_id", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_audio": op1_audio,
    "op2_pii": op2_pii,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_quality_rules": op8_quality_rules,
    "op9_source_mix": op9_source_mix,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_katz": op11_katz,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op3_sharding": oracles.SHARDS,
    "op4_line_dedup": oracles.LINES,
    "op5_near_duplicates": oracles.NEAR,
    "op10_suffix_dedup": oracles.REPEATS,
    "op12_prefix_trie": oracles.TRIE,
}
