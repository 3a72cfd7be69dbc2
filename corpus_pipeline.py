"""Documents to training tokens: quality, near copies, benchmark leaks, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on all that
the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermolith.llm import decontaminate, pieces, quality, simhash
from thermolith.llm.shared import drop_path, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good ones."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return simhash.without_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_copy_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: SQL can't express the classifier; run() is tested stage by stage against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, and
    dropped once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_path(spark, before)
        before = path
    return docs
