"""Verse tables (verse_id, text) from the stored tables, and other word sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("verse_id"), "text")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("verse_id"), "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn is a verse; its id is 'conv_id/turn'."""
    return table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("verse_id"), "text")


def write_strings(rendered: DataFrame, path: str) -> None:
    """Sink: the rendered strings as text files, a file a partition."""
    rendered.select("rendered").write.mode("overwrite").text(path)
