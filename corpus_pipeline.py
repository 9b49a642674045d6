"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Order: toxicity, SimHash near-dedup, benchmark decontamination, mixing sources to target weights,
sharding. Each stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narrascope.llm.common import materialize, read_table
from narrascope.llm.decontam import decontaminate
from narrascope.llm.mixing import mix
from narrascope.llm.sharding import shard_documents
from narrascope.llm.simhash import drop_near_duplicates
from narrascope.llm.toxicity import reject_toxic

SHARDS = 40
#: the mixture takes this many thousandths of the tokens that are left, each document at most once
BUDGET_PERMILLE = 600


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), remove="documents")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought towards their target weights within the token budget."""
    return mix(docs, budget_permille=BUDGET_PERMILLE, max_epochs=1).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get a shard; equal texts share one."""
    return shard_documents(docs, SHARDS)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL cannot express the trained toxicity model or the SimHash; ``tests/llm`` holds run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
