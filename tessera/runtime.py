"""Where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: str | None = None
#: Staged tables by the scratch block that they belong to; the first belongs to the application.
_frames: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode without a setting."""
    global _local
    conf = spark.sparkContext.getConf()
    if found := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local($|\[)", conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="tessera-")
    return _local


def stage(df: DataFrame, tag: str, outer: bool = False, most: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors.

    The shuffle files behind it are given back when the write ends. The table goes when the
    :func:`scratch` block around ends (with ``outer``, the one around that), else with the application.
    With ``most``, a file holds so many rows at most.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _frames[-2 if outer and len(_frames) > 1 else -1].append((spark, path))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", most).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch():
    """Staged tables made inside go at the end; what is returned must not depend on them, or be staged ``outer``."""
    _frames.append([])
    try:
        yield
    finally:
        _delete(_frames.pop())


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        if spark.sparkContext._jsc is None:
            continue
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception as error:  # the JVM may be gone at exit
            print(f"not removed: {path}: {type(error).__name__}", file=sys.stderr)
            return


def release() -> None:
    """Remove the application's staged tables; results that still depend on them must have been written."""
    tables, _frames[0][:] = list(_frames[0]), []
    _delete(tables)


atexit.register(lambda: release() if SparkSession.getActiveSession() else None)
