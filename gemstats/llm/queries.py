"""The registered queries of the subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gemstats.llm import decontaminate, exact_dedup, line_dedup, lm_score, minhash, mixing, prefix_trie, quality, simhash, spelling, substring_dedup, toxicity, warc
from gemstats.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by attention over its passages."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality as label")
    return quality.quality_scores(table(spark, sf_dir, "documents"), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every text: doc_id, held_out, score, expected_severity, severity, toxic."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "toxic as label")
    return toxicity.severity(table(spark, sf_dir, "documents"), labels)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by composable polynomial fingerprints."""
    return (exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of fingerprints at most 4 bits apart."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items: doc_id, item_id, score, place."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated runs, first copies aside."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between near-duplicate passages of at least 50 words."""
    return substring_dedup.near_passages(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text under the attention model."""
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document for the target mix."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with what its subtree saves."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose sets of 5-word shingles are at least 0.85 alike."""
    return minhash.minhash_groups(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, their forms one edit away, and the roots of these."""
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality, op2_toxicity, op3_warc, op4_exact_dedup, op5_simhash, op6_decontaminate, op7_line_dedup,
    op8_substring_dedup, op9_lm_score, op10_mixing, op11_prefix_trie, op12_minhash, op13_spelling)}
