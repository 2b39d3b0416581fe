"""A corpus pipeline of five stages: quality, near duplicates, benchmark passages, mixture, shards.

Every stage takes the documents that the one before kept and returns what it keeps, in the columns of documents;
the last returns where each row goes. Between stages tables are written and read again, so a stage that fails or
loses executors starts from files, not from the beginning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from compassframe.llm import decontamination, jaccard_join, linear_quality, mixing, sharding
from compassframe.llm.common import Scratch, documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return linear_quality.keep_good(docs, documents(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id."""
    return jaccard_join.keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: shard and slot of a uniform shuffle with shard sizes one apart at most."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: The first stage scores with a trained model and the fourth draws, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
