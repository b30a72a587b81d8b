"""A corpus from raw documents to a weighted mix, in five stages that each use one operator.

Stages get all that their predecessor kept, written as Parquet and read again.

Odd rows are defined by the operators and hold in every stage: null and empty texts have no words, so the
first stage drops them; null ids, langs and sources are kept as they are; equal rows are one document for the
second stage, which keeps that with the least hash of all columns; ties go to the least id, then to such a hash; very long texts are judged whole; columns
beyond those of documents stay with their values, whatever their names (the last stage's ``copies`` is named ``mix_copies`` where there is such a column); empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.llm.decontamination import remove_leaks
from veldmark.llm.jaccard_join import keep_one_of_each
from veldmark.llm.quality_rules import keep_good
from veldmark.llm.secret_scan import redact
from veldmark.llm.source_mixing import mix
from veldmark.llm.storage import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least id; documents without words stay all."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with its own or with other parameters, go."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, and n_chars follows, where there is one (that of null texts stays); documents stay."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents that are taken, and how often (copies); those without words never are."""
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: The verdict of the first stage is estimated and the copies of the last are drawn: SQL can't tell them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            work.drop(before)  # no later stage reads it
        before = docs
    return docs
