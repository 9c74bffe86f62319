"""A training corpus from the documents: quality rules, near duplicates, benchmark items, personal data, mixture.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of ``documents``; the
last adds how often the mix takes a document. The result of each stage is written as Parquet in the folder that all
executors share and read again, so a lost executor never repeats more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewise.llm import decontaminate, lines, mixing, privacy, simhash
from tracewise.llm.words import table
from tracewise.session import keep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose lines the field marks as boilerplate for the most part, go."""
    return lines.passing(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    return privacy.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies."""
    return mixing.mixed(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination),
          ("personal data", personal_data), ("mixing sources to target weights", mixture)]
ORACLE_SQL = None  # the field of the first stage and the trees of the fourth are learned


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
