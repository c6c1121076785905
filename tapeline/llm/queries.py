"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import importance_resampling, jaccard_join, lattice_hash, license_scan, line_templates, sentence_pieces, sql, string_tiling, substring_dedup, token_alignment, token_output, toxicity_crf, url_rules, vector_packing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_rows(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(_table(spark, sf_dir, "documents"))


def op3_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_crf.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return string_tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(_table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.digest(_table(spark, sf_dir, "pages"))


def op7_lattice_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_hash.digest(_table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digest(_table(spark, sf_dir, "documents"))


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.packed_pieces(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest(_table(spark, sf_dir, "documents"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of op10's method where all three limits can bind: whole conversations, of which the assistant's turns bear a loss."""
    examples = vector_packing.conversations(_table(spark, sf_dir, "conversations"))
    return vector_packing.packed_examples(examples).select("example_id", "n_tokens", "n_loss", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"packed_conversations": packed_conversations}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can state; the others rest on trained models, tokenizers, tilings or templates."""
    return {k: f() for k, f in vars(sql).items() if k in queries()}
