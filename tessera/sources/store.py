"""The graph on disk: folders of table versions that never change, and numbered manifests that name them.

A commit writes the changed tables into new folders, then a manifest that names a folder for every
table; tables that didn't change are named again, not copied. A manifest appears whole under the
next number or not at all, and the last one counts, so readers see all of a commit or nothing, and a
failed write leaves nothing that anyone reads. A reader takes all its tables from one manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema

MANIFESTS, TABLES = "manifests", "tables"


class ConcurrentCommit(RuntimeError):
    """Another writer has published since this one read."""


class GraphStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def snapshots(self) -> list[int]:
        """Numbers of the published manifests, oldest first."""
        where, fs = self._fs(MANIFESTS)
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> int | None:
        """Number of the current snapshot: looked up anew, so a published one is seen at once."""
        return max(self.snapshots(), default=None)

    def manifest(self, number: int | None = None) -> dict[str, str]:
        """Folder of each table, of the current or a given snapshot; read from the file system, without a job."""
        number = self.current() if number is None else number
        if number is None:
            return {}
        where, fs = self._fs(f"{MANIFESTS}/{number:012d}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _read(self, name: str, folders: dict[str, str]) -> DataFrame:
        if name not in folders:
            return schema.empty(self.spark, name)
        return schema.conform(self.spark.read.schema(schema.DDL[name]).parquet(f"{self.path}/{folders[name]}"), name)

    def table(self, name: str, number: int | None = None) -> DataFrame:
        return self._read(name, self.manifest(number))

    def tables(self, number: int | None = None) -> dict[str, DataFrame]:
        """All tables of one snapshot."""
        folders = self.manifest(number)
        return {name: self._read(name, folders) for name in schema.DDL}

    def commit(self, changed: dict[str, DataFrame]) -> int:
        """Publish a snapshot with the changed tables; the others are carried over as they lie.

        Raises ConcurrentCommit if another snapshot was published meanwhile; then nothing is published.
        """
        unknown = set(changed) - set(schema.DDL)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        before = self.current()
        folders = self.manifest(before) if before is not None else {}
        for table, df in changed.items():
            folder = f"{TABLES}/{table}/{uuid.uuid4().hex}"
            writer = schema.conform(df, table).write.mode("error")
            (writer.partitionBy("project_id") if table == "file" else writer).parquet(f"{self.path}/{folder}")
            folders[table] = folder
        return self._publish((before or 0) + 1, folders)

    def _publish(self, number: int, folders: dict[str, str]) -> int:
        staged, fs = self._fs(f"{MANIFESTS}/{uuid.uuid4().hex}.tmp")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        where, _ = self._fs(f"{MANIFESTS}/{number:012d}.json")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(staged, where, options)  # fails if the number is taken
        except Exception as error:
            fs.delete(staged, False)
            if fs.exists(where):
                raise ConcurrentCommit(f"snapshot {number} was published by another writer") from error
            raise
        return number

    def restore(self, number: int) -> int:
        """Publish an earlier snapshot again; nothing is copied."""
        return self._publish((self.current() or 0) + 1, self.manifest(number))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all manifests but the last few, and table folders that none of those names."""
        numbers, gone = self.snapshots(), []
        last = numbers[-max(1, keep) :]
        named = {folder for n in last for folder in self.manifest(n).values()}
        for n in numbers[: -max(1, keep)]:
            for folder in self.manifest(n).values():
                if folder not in named and folder not in gone:
                    gone.append(folder)
                    where, fs = self._fs(folder)
                    fs.delete(where, True)
            where, fs = self._fs(f"{MANIFESTS}/{n:012d}.json")
            fs.delete(where, False)
        return gone

    def clear_project(self, project_id: str) -> int:
        """Drop a project's files and everything that hangs on them, its communities' and coupling rows included."""
        t = self.tables()
        gone = t["file"].where(F.col("project_id") == F.lit(project_id)).select("id")
        return self.clear_files(gone, {"project": t["project"].where(F.col("id") != F.lit(project_id))})

    def clear_files(self, file_ids: DataFrame, more: dict[str, DataFrame] | None = None) -> int:
        """Drop files (id), their declarations, and edges at either end of them; then communities and flows that nothing is in."""
        t = self.tables()
        gone = file_ids.select("id")
        by_file = gone.withColumnRenamed("id", "file_id")
        classes = t["class"].join(by_file, "file_id", "left_anti")
        methods = t["method"].join(classes.select(classes["id"].alias("class_id")), "class_id", "left_semi")
        symbols = t["symbol"].join(by_file, "file_id", "left_anti")
        files = t["file"].join(gone, "id", "left_anti")
        out = {"file": files, "class": classes, "method": methods, "symbol": symbols}
        for name in ("site", "type_ref", "file_state"):
            out[name] = t[name].join(by_file, "file_id", "left_anti")
        ends_of = {"calls": (methods, methods), "overrides": (methods, methods), "implements": (classes, classes), "references_type": (methods, classes), "co_changed_with": (files, files)}
        for name, (source, target) in ends_of.items():
            e = t[name].join(source.select(source["id"].alias("src_id")), "src_id", "left_semi")
            out[name] = e.join(target.select(target["id"].alias("dst_id")), "dst_id", "left_semi")
        for name, group in (("in_community", "community"), ("in_flow", "flow")):
            out[name] = t[name].join(symbols.select(symbols["id"].alias("src_id")), "src_id", "left_semi")
            out[group] = t[group].join(out[name].select(F.col("dst_id").alias("id")).distinct(), "id", "left_semi")
        return self.commit(out | (more or {}))

    def clear_analysis(self) -> int:
        """Empty what analyses derive."""
        return self.commit({n: schema.empty(self.spark, n) for n in ("community", "flow", "in_community", "in_flow", "co_changed_with")})

    def reset(self) -> int:
        return self.commit({n: schema.empty(self.spark, n) for n in schema.DDL})
