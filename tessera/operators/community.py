"""Communities of symbols: label propagation over containment and calls, with a package fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import package_bucket
from tessera.runtime import stage

ROUNDS = 8


def symbol_edges(containment: DataFrame, calls: DataFrame) -> DataFrame:
    """a, b with a < b: both kinds of edge, undirected, once each, without loops."""
    both = containment.select("a", "b").unionByName(calls.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")))
    return both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def label_propagation(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """v, label: each round a vertex takes the label most of its neighbours and itself have, ties to the least.

    Votes are counted by (vertex, label) with a partial sum before the shuffle, so a hot vertex is no
    hot group. Rounds stop when nothing changes.
    """
    both = stage(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))), "neighbours")
    labels = stage(both.select("v").distinct().withColumn("label", F.col("v")), "labels")
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("v").alias("w"), "label"), "w").select("v", "label").unionByName(labels.select("v", "label"))
        votes = seen.groupBy("v", "label").agg(F.count(F.lit(1)).alias("n"))
        fresh = stage(votes.groupBy("v").agg(F.min(F.struct((-F.col("n")).alias("m"), "label"))["label"].alias("label")), "labels")
        changed = fresh.join(labels.withColumnRenamed("label", "was"), "v").where("label <> was").limit(1).count()
        labels = fresh
        if not changed:
            break
    return labels


def communities(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_id, community_id, label, size, cohesion of clustered symbols.

    symbols: id, fqname. Clusters of one member and symbols without edges go to their package bucket;
    buckets of one member go; if nothing is left, all symbols form one fallback community. The label
    is the most common bucket (ties to the least); cohesion is the share of all symbols.
    """
    spark = symbols.sparkSession
    named = symbols.select("id", package_bucket(F.col("fqname")).alias("bucket"))
    labels = label_propagation(edges)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    good = labels.join(sizes.where("n >= 2"), "label").select(F.col("v").alias("id"), F.concat(F.lit("graph:"), F.col("label").cast("string")).alias("community_id"))
    placed = named.join(good, "id", "left").withColumn("community_id", F.coalesce("community_id", F.concat(F.lit("pkg:"), "bucket")))
    total = named.count()
    counts = placed.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    kept = stage(placed.join(counts, "community_id"), "communities")
    if kept.isEmpty():
        if not total:
            return spark.createDataFrame([], "symbol_id string, community_id string, label string, size bigint, cohesion double")
        kept = named.withColumn("community_id", F.lit("fallback:1000000")).withColumn("size", F.lit(total).cast("bigint"))
    by_bucket = kept.groupBy("community_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    label = by_bucket.groupBy("community_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "bucket")).alias("b")).select("community_id", F.col("b.bucket").alias("label"))
    return kept.join(label, "community_id").select(F.col("id").alias("symbol_id"), "community_id", "label", "size", F.least(F.lit(1.0), F.col("size") / F.lit(total)).alias("cohesion"))


def community_table(found: DataFrame) -> DataFrame:
    """One row per community, largest first, then by label."""
    return found.select("community_id", "label", "size", "cohesion").distinct().orderBy(F.desc("size"), F.desc("label"), "community_id")


def symbol_community(found: DataFrame, symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Communities of the symbols that a query names by id, or by name without regard to case."""
    q = query.lower()
    named = symbols.where((F.col("id") == query) | (F.lower("fqname") == q) | (F.lower("name") == q)).select(F.col("id").alias("symbol_id"), "name", "fqname")
    return named.join(found, "symbol_id").orderBy("symbol_id").limit(limit)
