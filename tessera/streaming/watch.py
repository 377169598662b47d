"""File changes as a stream: micro-batches are the debounce, an event table is the overlay.

A watcher outside appends change records (project_id, path, op, content, ts); the stream turns each
micro-batch into overlay events, one for each file, the last change of the batch winning. Rewriting a
batch after a failure gives the same rows under the same sequence numbers, so the overlay's state,
the last event per file, doesn't change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import ids
from tessera.operators.versions import latest, upsert

CHANGES = "project_id string, path string, op string, content string, ts timestamp"
DEBOUNCE_MS = 1500


def overlay_events(batch: DataFrame, batch_id: int) -> DataFrame:
    """One event for each changed file of a batch."""
    keyed = batch.withColumn("file_id", ids.file_id(F.col("project_id"), F.col("path")))
    last = latest(keyed.withColumn("seq", F.unix_micros(F.col("ts").cast("timestamp"))), ["project_id", "file_id"])
    op = F.when(F.col("op") == "delete", "deleted").otherwise("dirty")
    return last.select("project_id", "file_id", op.alias("op"), F.when(F.col("op") != "delete", F.col("content")).alias("content"), F.col("path").alias("rel_path"), "seq")


def watch(spark: SparkSession, changes: str, overlay: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Follow a folder of change records (JSON lines) and write overlay events under ``overlay``."""
    stream = spark.readStream.schema(CHANGES).json(changes)

    def write(batch: DataFrame, batch_id: int) -> None:
        overlay_events(batch, batch_id).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(overlay)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{DEBOUNCE_MS} milliseconds")
    return writer.start()


def follow(engine, changes: str, documents: str, checkpoint: str, once: bool = False, poll_heads: bool = True) -> dict:
    """Follow change records and keep the overlay documents of an index up to date; then look whether heads have moved.

    Each micro-batch is one debounced set of edits: its files are parsed and resolved, deleted ones are
    marked, and their projects become dirty. With ``once``, what there is now is handled and the query ends.
    """
    stream = engine.spark.readStream.schema(CHANGES).json(changes)

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = latest(batch.withColumn("seq", F.unix_micros("ts")), ["project_id", "path"])
        edits = last.where("op <> 'delete'").select("project_id", F.col("path").alias("rel_path"), F.encode("content", "UTF-8").alias("content"))
        gone: dict[str, list[str]] = {}
        for r in last.where("op = 'delete'").select("project_id", "path").collect():
            gone.setdefault(r.project_id, []).append(r.path)
        engine.update_overlay(documents, edits, gone)
        if poll_heads:
            engine.poll_heads(documents)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{DEBOUNCE_MS} milliseconds")).start()
    query.awaitTermination()
    return {"batches": len(query.recentProgress)}


def changes_by_module(batch: DataFrame, modules: DataFrame) -> DataFrame:
    """project_id, changed: changed files of each module in a batch."""
    from tessera.sources.workspace import to_modules

    return to_modules(batch.select("path").distinct(), modules).groupBy("project_id").agg(F.count(F.lit(1)).alias("changed"))


def promotable(projects: DataFrame, heads: DataFrame, require_head_change: bool = True) -> DataFrame:
    """Projects whose overlay can be folded into the index: id, head."""
    joined = projects.join(heads.select(F.col("project_id").alias("id"), "head"), "id")
    moved = F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("indexed_commit"))
    return joined.where(moved if require_head_change else F.col("head").isNotNull()).select("id", "head")


def promoted(projects: DataFrame, due: DataFrame, now) -> DataFrame:
    """Project rows after promotion: commit and time set, overlay clean. Running it twice changes nothing more."""
    changed = projects.join(due, "id").withColumn("indexed_commit", F.col("head")).withColumn("indexed_at", now).withColumn("overlay_dirty", F.lit(False))
    return upsert(projects, changed.select(*projects.columns), ["id"])


def event_windows(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Extension: events counted and summed by type in tumbling or sliding windows, late ones up to a limit."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    out = grouped.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: sessions of users, closed by a gap."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
