"""Versioned tables: snapshot difference, merge-on-read overlay, incremental planning, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROMOTION = "present and coalesce(head, '') <> '' and coalesce(indexed_commit, '') <> '' and head <> indexed_commit"


def diff(base: DataFrame, head: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """key, status (added, removed, modified), and both sides' values as base_* and head_*, in one full outer join."""
    b = base.select(*key, *[F.col(c).alias(f"base_{c}") for c in compare], F.lit(True).alias("in_base"))
    h = head.select(*key, *[F.col(c).alias(f"head_{c}") for c in compare], F.lit(True).alias("in_head"))
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"base_{c}").eqNullSafe(F.col(f"head_{c}"))
    status = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "removed").when(~same, "modified")
    return b.join(h, key, "full_outer").withColumn("status", status).where("status is not null").drop("in_base", "in_head")


def suppressed(dirty: DataFrame, deleted: DataFrame, key: str = "file_id") -> DataFrame:
    """Keys whose base rows an overlay hides."""
    return dirty.select(key).union(deleted.select(key)).distinct()


def overlaid(base: DataFrame, overlay: DataFrame, hidden: DataFrame, key: str = "file_id") -> DataFrame:
    """Base rows of files that aren't hidden, and the overlay's rows."""
    return base.join(hidden, key, "left_anti").unionByName(overlay, allowMissingColumns=True)


def overlaid_edges(base: DataFrame, overlay: DataFrame, hidden_ends: DataFrame, src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """Base edges neither end of which is hidden, and the overlay's; edges into a changed file return with promotion."""
    h = hidden_ends.select("node")
    left = base.join(h.withColumnRenamed("node", src), src, "left_anti").join(h.withColumnRenamed("node", dst), dst, "left_anti")
    return left.unionByName(overlay, allowMissingColumns=True)


def latest(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key, by an aggregate that is combined before the shuffle; ties go to the greater row."""
    others = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max(F.struct(seq, *[c for c in others if c != seq])).alias("__last"))
    return last.select(*key, *[F.col(f"__last.{c}").alias(c) for c in others])


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Base with the changed keys' rows replaced or added."""
    return base.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def remove(base: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return base.join(gone.select(*key).distinct(), key, "left_anti")


def add_edges(edges: DataFrame, new: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with new ones whose both ends exist, once for each value of all their columns."""
    known = new.join(sources.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(targets.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    return edges.unionByName(known.select(*edges.columns)).dropDuplicates()


def plan(current: DataFrame, stored: DataFrame, full: bool = False) -> DataFrame:
    """file_id, action: added, changed, touched, unchanged or deleted.

    current: file_id, mtime, size, digest (a column that may be costly: it is needed only where mtime
    or size differ). stored: file_id, mtime, size, cached_hash, hash. With ``full`` all current files
    are changed or added.
    """
    c = current.select("file_id", F.col("mtime").alias("c_mtime"), F.col("size").alias("c_size"), "digest", F.lit(True).alias("here"))
    s = stored.select("file_id", "mtime", "size", "cached_hash", "hash", F.lit(True).alias("known"))
    quick = (F.col("c_mtime") == F.col("mtime")) & (F.col("c_size") == F.col("size")) & F.col("cached_hash").eqNullSafe(F.col("hash"))
    action = (
        F.when(F.col("here").isNull(), "deleted")
        .when(F.col("known").isNull(), "added")
        .when(F.lit(full), "changed")
        .when(quick, "unchanged")
        .when(F.col("digest") == F.col("hash"), "touched")
        .otherwise("changed")
    )
    return c.join(s, "file_id", "full_outer").select("file_id", action.alias("action"))


def overlay_status(summary: DataFrame, projects: DataFrame, heads: DataFrame) -> DataFrame:
    """project_id, present, dirty_files, deleted_files, indexed_commit, head, promotion_pending."""
    joined = projects.select(F.col("id").alias("project_id"), "indexed_commit").join(summary, "project_id", "left").join(heads, "project_id", "left")
    counted = joined.withColumn("dirty_files", F.coalesce("dirty_files", F.lit(0))).withColumn("deleted_files", F.coalesce("deleted_files", F.lit(0)))
    present = counted.withColumn("present", (F.col("dirty_files") > 0) | (F.col("deleted_files") > 0))
    return present.withColumn("promotion_pending", F.expr(PROMOTION))


def staleness(projects: DataFrame, now: Column, limit_s: int = 3600) -> DataFrame:
    """project_id, age_s and a warning like '2h 5m old' beyond the limit."""
    age = F.unix_timestamp(now) - F.unix_timestamp("indexed_at")
    text = F.concat(F.floor(age / 3600).cast("string"), F.lit("h "), F.floor(F.pmod(age, F.lit(3600)) / 60).cast("string"), F.lit("m old"))
    return projects.select(F.col("id").alias("project_id"), age.alias("age_s"), F.when(age > limit_s, text).alias("warning"))


def change_number(marker: Column, order: str, partition: str) -> Column:
    """Running count of markers: numbers the groups that they open."""
    return F.sum(marker.cast("int")).over(Window.partitionBy(partition).orderBy(order))
