"""A corpus pipeline: quality, exact and near copies, benchmark passages, then the mix.

Every stage takes null and empty texts, texts of any length, repeated rows and
an empty table, which gives an empty one. Rows that repeat a doc_id share its
fate; rows without a doc_id can't be named and stay, until the mix, which
doesn't draw them. Columns beyond those of ``documents`` are kept, whatever
their names. Each stage takes (spark, docs, sf_dir), docs being what the stage before it
kept, written as Parquet and read again. All but the last return the columns of
``documents``; the last adds what the documents weigh in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontam, dedup, mixing, quality, simhash
from keyloom.llm.common import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the documents that the classifier rejects go; null and empty texts are judged as texts of no words."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the one with the largest doc_id stays, its repeated rows too; null counts as empty."""
    return dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, for five-word Jaccard similarity of 0.8 or more: of each class of near copies the one with the least doc_id stays; texts without words are one class."""
    return simhash.near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a window of a benchmark item go; null texts and items have no words."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents are sampled by calibrated probabilities; mix_copies says how often. Nulls count as empty texts and names."""
    return mixing.mixed(docs)


STAGES = [("quality", quality_classifier), ("exact dedup", exact_copies), ("near dedup", near_copies), ("decontamination", benchmark_passages), ("mixing", target_mix)]

#: Fitting, fingerprints and raking are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
