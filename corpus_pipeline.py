"""The corpus pipeline over `documents`: quality rules, near-duplicate join, decontamination, secret masking, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. run() writes each stage's
result as Parquet to the shared folder and reads it again as the next one's docs.

Defined cases, in every stage: columns beside doc_id, text and lang go on untouched, whatever
their names; an empty table gives an empty one; texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metrika.llm import decontaminate, jaccard_join, packing, quality, secret_scan
from metrika.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and short texts fail the base, a null or unseen language has the base alone, rows of one id are judged each."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of the smallest doc_id stays, of equal ids one; rows without words, null texts too, are linked with nothing and stay."""
    return jaccard_join.filter_documents(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none, and rows of one id and text go together."""
    return decontaminate.filter_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every row stays, null and empty texts as they are."""
    return secret_scan.mask_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences; a null text is empty and still has its end id, repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The calibrated rules and the packing can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
