"""The corpus pipeline: documents to packed training sequences, one stage after another.

Defined cases: documents without a letter (null and empty texts among them) go in the first
stage; repeated rows are copies, of which one stays; columns beyond those of documents pass
through all stages but the last; an empty table gives no rows; very long texts are whole in
every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spoor.llm.common import discard, load, shared_dir
from spoor.llm.decontam import stage_decontaminate
from spoor.llm.langid import stage_language_id
from spoor.llm.near import stage_near
from spoor.llm.packing import stage_packing
from spoor.llm.secrets import stage_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return stage_language_id(spark, docs, sf_dir)


def near_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return stage_near(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are nothing else go."""
    return stage_decontaminate(spark, docs, sf_dir)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted."""
    return stage_secrets(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a training sequence."""
    return stage_packing(spark, docs, sf_dir)


STAGES = [
    ("language_id", language_id),
    ("near_join", near_join),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: No SQL: the language model, the Bayesian pruning and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = load(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{base}/{number}-{name}"
        out.write.parquet(path)
        if number:
            discard(docs)  # the stage before is not read any more
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
