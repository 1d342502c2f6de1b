"""The corpus pipeline: raw documents to token ids, one operator a stage.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and returns
a DataFrame; all but the last return the columns of documents. ``run`` applies them, writing each stage's rows as
Parquet in the shared folder and reading them again for the next.

Every stage takes null ids and null texts (as empty ones, which the quality stage rejects), empty and very long texts, rows that
repeat, ties (the row that comes first in the order of its operator stays) and other columns of any name, which are
kept. An empty table of documents gives an empty result, an empty benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnflow.llm import bpe, decontaminate, line_dedup, near_dup, quality_rules
from txnflow.llm.registry import PATTERN, RANKS, table
from txnflow.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines and rejected documents go."""
    return quality_rules.clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of several lines stay where they stand first."""
    return line_dedup.dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, with doc_id."""
    return bpe.token_report(spark, docs, RANKS, PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

#: Near duplicates and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
