"""A training corpus from the table documents: quality, exact duplicates, near duplicates, mixing, packing.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs; all but the last return the columns of
documents. Each works on all rows that the one before kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skychan.llm.common import ship, table, written
from skychan.llm.curriculum import training_rows
from skychan.llm.drr_pack import packed
from skychan.llm.exact_dedup import keep_first
from skychan.llm.ri_classifier import keep_good
from skychan.llm.voronoi_join import keep_one


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (operator 6)."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the first row stays (operator 9)."""
    ship(spark)
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (operator 2)."""
    ship(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mixture takes, in training order (operator 8)."""
    ship(spark)
    return training_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 tokens (operator 3)."""
    ship(spark)
    return packed(docs)


STAGES = [("quality", good), ("exact dedup", exact), ("near duplicates", near), ("mixing", mixing), ("packing", packing)]

#: The classifier and the packer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
