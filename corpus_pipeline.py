"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame; every stage's rows are written as Parquet and read
again for the next one, so a lost executor costs a stage's tasks and no more. All
stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from postmill.session import cut_lineage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labelled rows, predicts as toxic go."""
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine, keep=docs.columns).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with similarity 0.8 or more on five-word shingles, the smallest id stays."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    return decontaminate.judge(docs, _table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix, sources that run dry repeated, so shares hold to the end."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the slot and shard of their id, and their `position` in the mix, by which a shard is to be read."""
    return sharding.place(mixing.ordered(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The fit of the toxicity machine has no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

