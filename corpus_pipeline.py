"""A corpus pipeline over `documents`: toxicity, near-duplicates, PII, mixing, packing.

Each stage works on what its predecessor kept, and all but the last return the columns of `documents`. Mixing takes
effect as the order of the rows, over files and in them. Files that are read again come in no order, so packing finds the
slots again, which follow from the rows alone, and packs along them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from patchlens.llm import common, neardup, queries


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.without_toxic(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.without_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.in_mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed_in_mixed_order(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: The stages learn a model, link by signatures and tokenize: SQL can't express them. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage returns is written to the shared folder and read again by the next, after which it goes."""
    at = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            common.remove(spark, before)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
