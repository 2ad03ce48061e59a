"""A corpus pipeline over the operators of tidemark.llm; each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, neardup, rules, substrings
from tidemark.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the web policy of the quality rules."""
    return rules.keep(docs, "text", rules.WEB)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.keep(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a text that loses nothing stays as it is.

    A document that loses all its words goes, the others keep what is left, their words joined by one space.
    """
    d = substrings.dedup(docs, keep_whole=True).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept").cast("long"))}
    return d.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mix: runs of words in the order of slots."""
    return mixing.texts(mixing.mix(docs), docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("mixing", mixture)]

#: SQL cannot express MinHash groups or the schedule; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
