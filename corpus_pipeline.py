"""The corpus pipeline: stages that each take the documents which their predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, minhash, mixing, quality, sharding
from tessera.llm.common import documents, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the band of their language or script, columns unchanged.

    Null and empty texts fail the base rule; without a column ``lang`` every text is judged by its script;
    equal rows go or stay together; long texts are measured whole; an empty table stays empty.
    """
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, columns unchanged.

    Null and empty texts are near nothing and stay; rows of equal id and text are one document; a null
    id counts as the greatest; long texts are compared whole; an empty table stays empty.
    """
    return minhash.kept_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item, columns unchanged.

    Null and empty texts are clean; items without words match nothing; equal rows go or stay
    together; long texts are searched whole; empty tables remove nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, columns unchanged.

    A null source, or a table without ``source``, is one source; documents without words are taken with
    their hash's share; equal rows are taken alike; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents, with shard and slot; equal texts share a shard.

    Columns of the documents that are named like a result (size, text_crc32, law, shard, slot,
    grown_shard) give way to it. Null texts count as empty; equal rows get different slots; an empty
    table stays empty.
    """
    return sharding.shards(docs, 8, keep=True)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("sharding", sharded),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for number, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{number}")
    return docs
