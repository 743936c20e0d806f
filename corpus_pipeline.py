"""The training corpus pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, minhash_dedup, mixing, pii, toxicity
from tidewatch.llm.joins import Scratch

PII_KEY = "tidewatch-demo-key"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on labelled rows of the input, drop documents that score 0.5 or more."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near-duplicates."""
    return minhash_dedup.deduplicate(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms."""
    return pii.pseudonymize(docs, PII_KEY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents by their source's rate; `copy` counts from 1."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", contamination), ("privacy", privacy), ("mixing", mixture)]
#: the classifier of the first stage has no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder and read again.

    A stage's folder is deleted once the next one is written; the last one read, when the process ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        folder = Scratch(spark)
        docs = folder.store(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
