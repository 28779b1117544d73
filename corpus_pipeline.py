"""A corpus pipeline of five text operators, from raw documents to a mix.

Each stage works on everything that its predecessor kept.  All stages but the
last return the columns of ``documents``; the last returns what the mix takes
of each document.  Between stages the documents are written as Parquet to the
folder that the cluster shares and read again; what a stage wrote besides, and
its input, is removed then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontamination, line_dedup, mixing, ngram_join, quality_rules
from panelwright.llm._storage import Stages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go."""
    return quality_rules.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too large a share of a source's pages have go; ``n_chars`` follows the text."""
    return line_dedup.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 75 % of their five-word shingles the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item within its error budget go."""
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document when the sources are mixed to their weights."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", reject_by_quality),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: The rules of the first stage are learned, and links are closed transitively: SQL states neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stages = _table(spark, sf_dir, "documents"), Stages(spark)
    for name, stage in STAGES[:-1]:
        docs = stages.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
