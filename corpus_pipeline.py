"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
each result as Parquet to the shared folder of the session and hands what it
reads back to the next. All but the last return the columns of documents.

Cases: documents without words are rejected by the first stage; null ids,
repeated rows, empty tables and other columns go through every stage as its
operator states.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm import decontaminate, mixing, ngram_join, pii, quality_rules
from encore.llm.common import cut, prepare, shared_folder, table


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or that the forest isolates."""
    prepare(spark)
    stats = cut(quality_rules.rule_statistics(docs))
    return quality_rules.reject(docs, quality_rules.fit(stats, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five words, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, similar=80, plan=ngram_join.PLAN_80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what test items contain; drops documents that are mostly that."""
    return _sized(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data."""
    return _sized(pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered in `copy`."""
    return mixing.emit(mixing.plan(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("ngram_join", near_duplicates), ("decontaminate", benchmark), ("pii", personal_data),
    ("mixing", mix)]

#: No SQL: the first stage is a forest of random splits. tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
