"""Documents through the training-data operators, stage by stage.

Each stage takes the documents that its predecessor kept, with the columns of
``documents``, and returns them with its decisions applied; the last one adds
``copy``.  Null and empty texts fail the base rules; empty tables pass through;
further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkaudit.llm import bottomk, mixing, rules_forest, secrets_ledger, winnowing
from sparkaudit.llm.common import new_table_path, table
from sparkaudit.llm.registry import importable

#: Similarity, in percent, at which documents are near duplicates here; op10 has its own.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the isolation forest finds anomalous go."""
    return rules_forest.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8 or more) the document with the smallest id stays."""
    return bottomk.one_of_each(docs, percent=NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any hit of a benchmark item go."""
    return winnowing.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secrets_ledger.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out until each source comes near its target; ``copy`` counts the repeats."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing_sources),
]

#: Isolation forest and sketches have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents.  Each stage is written as Parquet in the shared folder and read again."""
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_table_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
