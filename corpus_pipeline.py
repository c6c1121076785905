"""The corpus pipeline: documents without toxic ones, recurring lines, copies and benchmark items, packed.

Defined cases, alike in all stages: a null or empty text is an empty document, which no stage rejects; null ids are
kept; equal rows are judged alike, and the join keeps one of them (empty ones all); very long texts are read whole; ties
in the join go to the smallest doc_id; an empty table gives an empty result; of the columns of ``documents`` only
those in COLUMNS are passed on, so others, of whatever names, don't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import jaccard_join, line_templates, string_tiling, toxicity_crf, vector_packing
from tapeline.llm.dist import shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity_crf.remove_toxic(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays. n_chars stays what it was in the input."""
    return line_templates.drop_templates(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, one of each group stays."""
    return jaccard_join.keep_one(docs, n=5, threshold=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return string_tiling.remove_contaminated(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a packed sequence."""
    return vector_packing.packed_pieces(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: The stages can't be stated in SQL (a trained model, global templates, tokenizers); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    path = shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
