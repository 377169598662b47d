"""Counts over the graph: projects, packages, capabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(tables: dict[str, DataFrame], group: str) -> DataFrame:
    """One row per group and table name with its rows: the tables are counted in one pass each."""
    parts = [df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).select(group, F.lit(name).alias("what"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def with_totals(tables: dict[str, DataFrame], group: str) -> DataFrame:
    """A column per table, a row per group, and a total row whose group is null, by rollup."""
    counted = counts_by(tables, group)
    columns = [F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for name in tables]
    return counted.rollup(group).agg(*columns)


def list_projects(projects: DataFrame, files: DataFrame, symbols: DataFrame, now: Column) -> DataFrame:
    """project_id, files, symbols, age_s; projects without files are kept with zeros."""
    f = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    s = symbols.join(files.select(F.col("id").alias("file_id"), "project_id"), "file_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("symbols"))
    base = projects.select(F.col("id").alias("project_id"), (F.unix_timestamp(now) - F.unix_timestamp("indexed_at")).alias("age_s"))
    joined = base.join(f, "project_id", "left").join(s, "project_id", "left")
    return joined.select("project_id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("symbols", F.lit(0)).alias("symbols"), "age_s")


def list_packages(classes: DataFrame, limit: int = 200) -> DataFrame:
    """package, project_id, classes: most classes first."""
    counted = classes.groupBy("package", "project_id").agg(F.count(F.lit(1)).alias("classes"))
    return counted.orderBy(F.desc("classes"), "package", "project_id").limit(limit)


def capabilities(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: for each table whether it has rows, and how many symbols carry a vector."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.range(1).select()
    for name, df in tables.items():
        out = out.crossJoin(df.agg((F.count(F.lit(1)) > 0).alias(f"has_{name}")))  # one row each
    if "symbol" in tables and "embedding" in tables["symbol"].columns:
        out = out.crossJoin(tables["symbol"].agg(F.count_if(F.col("embedding").isNotNull()).alias("embedded")))
    return out
