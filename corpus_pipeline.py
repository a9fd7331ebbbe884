"""Corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all of its predecessor's
documents and is written as Parquet before the next one reads it.  All but the
last return the columns of ``documents``.

* ``quality``: documents the classifier rejects go.
* ``lines``: repeated lines go; ``n_chars`` follows the text; a document left
  without any text by this goes (its lines are all kept elsewhere).
* ``near_dups``: one document of each class of near copies stays (five-word
  shingles, similarity 0.8 or more).
* ``benchmark``: documents that hold a benchmark window go.
* ``tokens``: ids of each text, with round trip and parity.

Nulls, empty texts, repeated rows, empty tables and further columns are handled
as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import decontaminate, line_dedup, near_dedup, rule_ensemble, spm
from cairnspark.llm.common import discard, table, written
from cairnspark.llm.queries import SPM_MODEL

#: SQL cannot express a fitted classifier, exact set similarity classes or subword merges; tests/llm holds run() against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ensemble.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    dropped = F.col(out.columns[-1]).n_dropped
    n_chars = F.when(dropped > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.where((dropped == 0) | F.col("text").rlike(r"\S")).withColumn("n_chars", n_chars).drop(out.columns[-1])


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~F.col(out.columns[-1]).contaminated).drop(out.columns[-1])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spm.encode_decode(docs, SPM_MODEL)


STAGES = [("quality", quality), ("lines", lines), ("near_dups", near_dups), ("benchmark", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written in the shared folder and read again, and the one before it deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
