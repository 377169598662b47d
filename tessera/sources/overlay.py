"""Uncommitted edits: one JSON document per project, or an append-only table of events."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import sha1_text
from tessera.operators.versions import latest

DOCUMENT = """project_id string, project_path string, repo_root string, base_commit string, current_head string,
dirty_files map<string, struct<file_path: string, rel_path: string, file_id: string, file_hash: string, is_test: boolean,
  symbols: array<struct<id: string, kind: string, name: string, fqname: string, file_id: string, line: bigint, col: bigint>>,
  methods: array<struct<id: string, class_id: string, name: string, signature: string, fqcn: string, file_id: string, is_test: boolean>>,
  calls: array<struct<src: string, dst: string, confidence: double, reason: string>>>>,
deleted_files array<string>, updated_at bigint"""
#: project_id, file_id, op ('dirty', 'deleted' or 'clear'), seq.
EVENTS = "project_id string, file_id string, op string, content string, rel_path string, seq bigint"


def read_documents(spark: SparkSession, path: str, projects: DataFrame | None = None) -> DataFrame:
    """Overlay documents; with ``projects`` (id, path), an empty one for each project whose document is missing or broken."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where):
        found = spark.read.schema(DOCUMENT).option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path).where("project_id is not null")
    else:
        found = spark.createDataFrame([], DOCUMENT)
    if projects is None:
        return found
    named = projects.select(F.col("id").alias("project_id"), F.col("path").alias("__path"))
    return named.join(found, "project_id", "left").withColumn("project_path", F.coalesce("project_path", "__path")).select(*found.columns)


def dirty(documents: DataFrame) -> DataFrame:
    return documents.select("project_id", F.explode("dirty_files").alias("path", "f")).select("project_id", "path", "f.*")


def deleted(documents: DataFrame) -> DataFrame:
    """project_id, file_id of deletion marks: paths relative to the project."""
    rows = documents.select("project_id", "project_path", F.explode("deleted_files").alias("path"))
    rel = F.when(F.col("path").startswith(F.concat("project_path", F.lit("/"))), F.expr("substring(path, length(project_path) + 2)")).otherwise(F.col("path"))
    return rows.select("project_id", F.sha1(F.concat("project_id", F.lit(":"), rel)).alias("file_id"))


def summary(documents: DataFrame) -> DataFrame:
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    return documents.groupBy("project_id").agg(F.sum(size("dirty_files")).alias("dirty_files"), F.sum(size("deleted_files")).alias("deleted_files"))


def state(events: DataFrame) -> DataFrame:
    """The last event of each file after its project was last cleared."""
    cleared = events.where("op = 'clear'").groupBy("project_id").agg(F.max("seq").alias("cleared"))
    live = events.where("op <> 'clear'").join(cleared, "project_id", "left").where("cleared is null or seq > cleared").drop("cleared")
    return latest(live, ["project_id", "file_id"])


def write_document(spark: SparkSession, path: str, project_id: str, document: str) -> None:
    """Replace a project's document: written beside it and moved over it, so a reader sees the old one or the new one."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{sha1_text(project_id)}.json")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_{sha1_text(project_id)}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(document.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, options)


def read_document(spark: SparkSession, path: str, project_id: str, project_path: str = "") -> dict:
    """A project's document as a dictionary; an empty one if it is missing or broken."""
    empty = {"project_id": project_id, "project_path": project_path, "dirty_files": {}, "deleted_files": []}
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{sha1_text(project_id)}.json")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return empty
    stream = fs.open(target)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except json.JSONDecodeError:
        return empty
    finally:
        stream.close()
    return empty | found if isinstance(found, dict) else empty


def upsert_files(document: dict, files: dict[str, dict], **header) -> dict:
    """The document with files (by path) added or replaced; they are no longer marked as deleted."""
    kept = [p for p in document["deleted_files"] if p not in files]
    return document | header | {"dirty_files": document["dirty_files"] | files, "deleted_files": kept, "updated_at": int(time.time())}


def mark_deleted(document: dict, paths: list[str], **header) -> dict:
    """The document with paths marked as deleted and no longer dirty."""
    left = {p: f for p, f in document["dirty_files"].items() if p not in paths}
    return document | header | {"dirty_files": left, "deleted_files": sorted({*document["deleted_files"], *paths}), "updated_at": int(time.time())}


def clear(spark: SparkSession, path: str, project_id: str | None = None) -> None:
    """Remove a project's document, or all of them."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(base) if fs.exists(base) else []:
        name = status.getPath().getName()
        if name.endswith(".json") and (project_id is None or name == f"{sha1_text(project_id)}.json"):
            fs.delete(status.getPath(), False)
