"""Helpers that the training-data operators share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import scratch, shared_dir, stage

__all__ = ["bounded", "documents", "scratch", "shared_dir", "ship", "small_batches", "stage", "words_in"]

#: What separates words of texts: ASCII white space.
BETWEEN = r"[\x20\x09-\x0D]+"
#: Rows and bytes in an Arrow batch, whichever is reached first; whole texts travel in them.
ARROW_ROWS = 512
ARROW_BYTES = "16m"


def ship(name: str) -> None:
    """Send a module's functions to executors by value, so that no installation is needed there."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by rows and bytes, as whole texts may be long: for the session, since results are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


#: Rows of keys, of some 100 bytes each, that a broadcast may have.
BROADCAST_ROWS = 500_000


def bounded(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of keys, to be broadcast if counting shows that it has ``most`` rows or fewer; else joined by a shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table.hint("merge")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, BETWEEN), "")), F.lit(0)).cast("long")


ship(__name__)
