"""A corpus pipeline over ``documents``: five stages, each one training-data operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller
writes it as Parquet and rereads it as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksieve.llm import decontaminate, langid, line_dedup, mixing, simhash
from sparksieve.llm.common import drop_table, scratch_path, table, temporary

#: Words in a shingle of the near-duplicate stage, and the share of common shingles that links two texts.
SHINGLE, SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the fused evidence accepts."""
    return langid.drop_unidentified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated line windows go; a document that loses its last words goes with them.

    ``n_chars`` follows the text. Documents without any words before are kept.
    """
    out = line_dedup.dedup_lines(docs)
    empty = F.btrim(F.col("text"), F.lit(" \t\r\n")) == ""
    out = out.where((F.col("removed_lines") == 0) | ~empty)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; every link of a group is verified."""
    return simhash.drop_near_copies(docs, similarity=SIMILARITY, shingle=SHINGLE)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with its rate and copy number."""
    return mixing.mixed_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("mixture", mixture)]

#: SimHash classes, tiling and Newton steps are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Of the tables written, the last stage's result alone is kept."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_table(before, spark)
        before = path
    return docs
