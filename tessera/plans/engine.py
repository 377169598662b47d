"""One object for an index on disk: ingest, search, analyses, overlay, SQL and graph patterns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import ids
from tessera.functions.text import hash_vector
from tessera.operators import community, coupling, deadcode, graph, ingest, resolve, search, stats, versions
from tessera.plans.match import to_sql
from tessera.runtime import shared_dir, stage
from tessera.sources import git, java, overlay, workspace
from tessera.sources.store import GraphStore


#: Files up to this number are opened by path; beyond it a scan of the folder is filtered.
FEW_FILES = 2_000


class Engine:
    """All methods return DataFrames, or publish a snapshot and return its name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, GraphStore(spark, path)

    # ingest

    def source_files(self, root: str) -> DataFrame:
        """project_id, path, rel_path, mtime, size, content of a workspace's modules."""
        out = None
        for module, project in workspace.project_ids(root):
            rows = java.scan(self.spark, module).withColumn("project_id", F.lit(project))
            out = rows if out is None else out.unionByName(rows)
        return out

    def plan(self, files: DataFrame, full: bool = False) -> DataFrame:
        """file_id, action, path, mtime, size, digest, staged; contents are read and hashed only where time or size differ."""
        state = self.store.table("file_state")
        stored = stage(self.store.table("file").select(F.col("id").alias("file_id"), "hash").join(state, "file_id", "left"), "stored-files")
        current = files.select(ids.file_id(F.col("project_id"), F.col("rel_path")).alias("file_id"), "path", "mtime", "size")
        quick = stage(versions.plan(current.withColumn("digest", F.lit(None).cast("string")), stored, full), "quick-plan")
        doubtful = current.join(quick.where("action in ('added', 'changed')"), "file_id").select("file_id", "path")
        digest = self.contents(files, doubtful).select("file_id", F.sha1("content").alias("digest"))
        known = stage(current.join(digest, "file_id", "left"), "hashed-files")
        return stage(versions.plan(known, stored, full).join(known, "file_id", "left"), "plan")

    def contents(self, files: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows of ``files`` that ``wanted`` (file_id, path) names, with their content; few are opened by their paths alone."""
        keyed = files.withColumn("file_id", ids.file_id(F.col("project_id"), F.col("rel_path")))
        paths = [r.path for r in wanted.select("path").limit(FEW_FILES + 1).collect()]
        if len(paths) > FEW_FILES:
            return keyed.join(wanted.select("file_id"), "file_id", "left_semi")
        read = java.read_files(self.spark, paths)
        return keyed.drop("content").join(read.join(wanted, "path").select("file_id", "content"), "file_id")

    def analyse(self, root: str, full: bool = False, embed: bool = False, deep: bool = True, model: str = "hash", vector=None, **options) -> dict[str, int]:
        """Index a workspace and publish it; counts of what was done. Nothing is written if nothing changed.

        Only added and changed files are parsed. Names are resolved again over all call sites, from the
        stored tables, so edges from unchanged files into changed ones are never lost. ``vector`` maps a
        text column to a vector of VECTOR_DIM numbers, by default hashed words; ``model`` names it in the cache.
        """
        files = self.source_files(root)
        return self._publish(files, self.plan(files, full), root, embed, deep, model, vector, options)

    def _publish(self, files: DataFrame, plan: DataFrame, root: str | None, embed: bool, deep: bool, model: str, vector, options: dict) -> dict[str, int]:
        actions = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
        indexed = actions.get("added", 0) + actions.get("changed", 0)
        out = {"files_found": sum(n for a, n in actions.items() if a != "deleted"), "files_indexed": indexed, "files_deleted": actions.get("deleted", 0)}
        state = plan.where("action <> 'deleted'").join(self.store.table("file_state").select("file_id", "cached_hash"), "file_id", "left")
        state = state.select("file_id", "mtime", "size", F.coalesce("digest", "cached_hash").alias("cached_hash"))
        if not indexed and not out["files_deleted"]:
            if actions.get("touched"):
                self.store.commit({"file_state": state})
            return out
        fresh = plan.where("action in ('added', 'changed')").select("file_id", "path")
        gone = stage(plan.where("action in ('added', 'changed', 'deleted')").select("file_id"), "gone-files")
        parsed = ingest.tables(ingest.parse_files(self.contents(files, fresh).drop("file_id"), **options))
        tables = ingest.merged(self.store.tables(), parsed, gone)
        written = {**tables, **ingest.resolved(tables), "file_state": state}
        if embed:
            embed_with = vector or (lambda text: hash_vector(text, schema.VECTOR_DIM))
            returned = ingest.with_classes(tables).select(F.concat("class_fqcn", F.lit("#"), "signature").alias("fqname"), "file_id", "return_type")
            named = tables["symbol"].join(returned.dropDuplicates(["fqname", "file_id"]), ["fqname", "file_id"], "left")
            told = ingest.symbol_text(F.col("kind"), F.col("fqname"), F.col("return_type"))
            written["symbol"], written["embedding_cache"] = search.embedded(named, self.store.table("embedding_cache"), told, embed_with, model, schema.VECTOR_DIM)
        if root is not None:
            projects = [(p, m, "java", git.head(m)) for m, p in workspace.project_ids(root)]
            fresh_projects = self.spark.createDataFrame(projects, "id string, path string, language string, indexed_commit string").withColumn("indexed_at", F.current_timestamp())
            dirty = self.store.table("project").select("id", "overlay_dirty")
            written["project"] = fresh_projects.join(dirty, "id", "left").withColumn("overlay_dirty", F.coalesce("overlay_dirty", F.lit(False)))
        written["schema_meta"] = self.spark.createDataFrame([("version", schema.VERSION)], schema.DDL["schema_meta"])
        self.store.commit(written)
        if deep:
            self.deep(root)
        names = ("class", "method", "symbol", "calls", "implements", "overrides", "references_type")
        now = self.store.tables()
        return out | ingest.counters({n: now[n] for n in names} | {"embeddings": now["symbol"].where("embedding is not null")})

    def reindex_file(self, path: str, deep: bool = False) -> dict[str, int] | None:
        """Index one file anew, or drop it if it is gone; None if no project holds the path."""
        project = self.infer_project(path)
        if project is None:
            return None
        base = self.repo_path(project)
        rel = path[len(base.rstrip("/")) + 1 :]
        one = java.read_files(self.spark, [path]).withColumn("rel_path", F.lit(rel)).withColumn("project_id", F.lit(project))
        there = not one.isEmpty()
        if not there:
            one = one.where("false")
        key = ids.file_id(F.lit(project), F.lit(rel))
        known = self.store.table("file").where(F.col("id") == key).limit(1).count()
        action = "deleted" if not there else "changed" if known else "added"
        if action == "deleted" and not known:
            return {"files_found": 0, "files_indexed": 0, "files_deleted": 0}
        here = one.select(key.alias("file_id"), "path", "mtime", "size", F.sha1("content").alias("digest"))
        row = self.spark.range(1).select(key.alias("file_id"), F.lit(action).alias("action")).join(here, "file_id", "left")
        others = self.store.table("file_state").where(F.col("file_id") != key)
        rest = others.select("file_id", F.lit("unchanged").alias("action"), F.lit(None).cast("string").alias("path"), "mtime", "size", F.lit(None).cast("string").alias("digest"))
        return self._publish(one, stage(row.unionByName(rest), "plan"), None, False, deep, "hash", None, {})

    def deep(self, root: str | None = None) -> None:
        """Communities, flows and change coupling, derived anew."""
        t = self.store.tables()
        methods = self.methods()
        by_name = t["symbol"].select("id", "fqname", "file_id")
        method_symbol = methods.join(by_name.withColumnRenamed("id", "symbol_id"), ["fqname", "file_id"]).select("id", "symbol_id", "class_symbol_name", "file_id")
        class_symbol = by_name.select(F.col("id").alias("a"), F.col("fqname").alias("class_symbol_name"), "file_id")
        containment = method_symbol.join(class_symbol, ["class_symbol_name", "file_id"]).select("a", F.col("symbol_id").alias("b"))
        names = method_symbol.select("id", "symbol_id")
        calls = t["calls"].join(names.select(F.col("id").alias("src_id"), F.col("symbol_id").alias("s")), "src_id").join(names.select(F.col("id").alias("dst_id"), F.col("symbol_id").alias("d")), "dst_id")
        edges = community.symbol_edges(containment, calls.select(F.col("s").alias("src_id"), F.col("d").alias("dst_id")))
        found = community.communities(t["symbol"], edges)
        entries = graph.entry_methods(methods)
        flow = graph.flows(t["calls"], entries)
        changed = {
            "community": community.community_table(found).select(F.col("community_id").alias("id"), "label", "cohesion"),
            "in_community": found.select(F.col("symbol_id").alias("src_id"), F.col("community_id").alias("dst_id")),
            "flow": flow.select(F.concat(F.lit("flow:"), "entry").alias("id"), F.col("entry").alias("entry_symbol_id"), "kind").distinct(),
            "in_flow": flow.join(names.withColumnRenamed("id", "node"), "node").select(F.col("symbol_id").alias("src_id"), F.concat(F.lit("flow:"), "entry").alias("dst_id"), "depth"),
        }
        if root is not None and git.root(root):
            changed["co_changed_with"] = self.mined_coupling(root)
        self.store.commit(changed)

    def mined_coupling(self, root: str, months: int = coupling.MONTHS) -> DataFrame:
        """co_changed_with edges of a repository's log; paths are mapped to modules first."""
        base = git.root(root)
        members = coupling.change_sets(git.log_lines(self.spark, base, months), git.MARK)
        modules = self.spark.createDataFrame(workspace.project_ids(root), "module_path string, project_id string")
        named = workspace.to_modules(members.withColumn("path", F.concat(F.lit(base + "/"), "item")), modules)
        folder = {p: m for m, p in workspace.project_ids(root)}
        prefix = self.spark.createDataFrame(list(folder.items()), "project_id string, module_path string")
        rel = F.expr("substring(path, length(module_path) + 2)")
        as_ids = named.join(prefix, "project_id").select("change", ids.file_id(F.col("project_id"), rel).alias("item"))
        return coupling.coupling_edges(coupling.coupled(as_ids), months)

    # reads

    def _tables(self, documents: DataFrame | None) -> dict[str, DataFrame]:
        return self.store.tables() if documents is None else self.overlaid(documents)

    def methods(self, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """Methods with class, qualified name, file and project."""
        t = tables or self.store.tables()
        c = t["class"].select(F.col("id").alias("class_id"), "fqcn", "file_id")
        f = t["file"].select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "project_id")
        joined = t["method"].join(c, "class_id").join(f, "file_id")
        return joined.withColumn("fqname", F.concat("fqcn", F.lit("#"), "signature")).withColumn("class_symbol_name", F.col("fqcn"))

    def symbols(self, project: str | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        t = tables or self.store.tables()
        f = t["file"].select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "project_id", "is_test")
        found = t["symbol"].join(f, "file_id")
        return found.where(F.col("project_id") == project) if project else found

    def search(self, query: str, k: int = 20, project: str | None = None, documents: DataFrame | None = None, sources: DataFrame | None = None, vector: Column | None = None) -> DataFrame:
        """The k best symbols with context; over uncommitted edits with ``documents``, with snippets where ``sources`` (file_id, content) are given.

        ``vector`` is the query's vector if another model than hashed words has made the index's.
        """
        t = self._tables(documents)
        symbols = self.symbols(project, t)
        if vector is None and symbols.where("embedding is not null").limit(1).count():
            vector = hash_vector(F.lit(query), schema.VECTOR_DIM)
        found = search.with_context(search.hybrid(symbols, query, k, vector), t["in_community"], t["community"], t["in_flow"])
        if sources is not None:
            found = search.with_snippets(found, sources)
        return found.orderBy(F.desc("score"), "id")

    def find_symbol(self, query: str, limit: int = 20, documents: DataFrame | None = None) -> DataFrame:
        t = self._tables(documents)
        f = t["file"].select(F.col("id").alias("file_id"), "project_id")
        return search.find_symbol(t["class"].withColumn("fqname", F.col("fqcn")).join(f, "file_id"), self.methods(t), query, limit)

    def impact(self, query: str, max_depth: int = 4, project: str | None = None, documents: DataFrame | None = None) -> DataFrame:
        t = self._tables(documents)
        methods = self.methods(t)
        scoped = methods.where(F.col("project_id") == project) if project else methods
        roots = search.resolve_ids(scoped.select("id", "name", "fqname"), query).select(F.col("id").alias("node"))
        return graph.with_method_meta(graph.impact(t["calls"], roots, max_depth), t["method"], t["class"], t["file"])

    def flows(self, query: str | None = None, max_depth: int = 6) -> DataFrame:
        methods = self.methods()
        entries = graph.flow_entries(methods, query) if query else graph.entry_methods(methods)
        return graph.flows(self.store.table("calls"), entries, max_depth)

    def dead_code(self, limit: int = 200, project: str | None = None, strict: bool = False) -> DataFrame:
        m = self.methods().withColumnRenamed("id", "method_id").withColumnRenamed("fqcn", "class_fqcn")
        m = m.where(F.col("project_id") == project) if project else m
        return deadcode.dead_methods(m, self.store.table("calls"), self.store.table("overrides"), limit, strict)

    def neighbourhood(self, method_id: str) -> DataFrame:
        t = self.store.tables()
        return graph.with_method_meta(graph.neighbourhood(method_id, t["calls"], t["method"], t["overrides"]), t["method"], t["class"], t["file"])

    def community_of(self, query: str) -> DataFrame:
        t = self.store.tables()
        found = t["in_community"].join(t["community"], F.col("dst_id") == F.col("id")).select(F.col("src_id").alias("symbol_id"), F.col("dst_id").alias("community_id"), "label", "cohesion")
        return community.symbol_community(found, t["symbol"], query)

    def change_coupling(self, item: str | None = None, **options) -> DataFrame:
        return coupling.get_coupling(self.store.table("co_changed_with"), item, **options)

    def context(self, query: str, max_depth: int = 3) -> dict[str, DataFrame]:
        return {"search": self.search(query, 10), "impact": self.impact(query, max_depth), "community": self.community_of(query), "flows": self.flows(query, max_depth + 2)}

    def stats(self) -> DataFrame:
        t = self.store.tables()
        f = t["file"].select(F.col("id").alias("file_id"), "project_id")
        classes = t["class"].join(f, "file_id")
        methods = self.methods()
        out = t["calls"].join(methods.select(F.col("id").alias("src_id"), "project_id"), "src_id")
        embedded = t["symbol"].where("embedding is not null").join(f, "file_id")
        return stats.with_totals({"files": t["file"], "classes": classes, "methods": methods, "calls_out": out, "embeddings": embedded}, "project_id")

    def projects(self, now: Column | None = None) -> DataFrame:
        t = self.store.tables()
        return stats.list_projects(t["project"], t["file"], t["symbol"], now if now is not None else F.current_timestamp())

    def packages(self, limit: int = 200) -> DataFrame:
        f = self.store.table("file").select(F.col("id").alias("file_id"), "project_id")
        return stats.list_packages(self.store.table("class").join(f, "file_id"), limit)

    def capabilities(self) -> DataFrame:
        t = self.store.tables()
        return stats.capabilities({n: t[n] for n in ("file", "symbol", "calls", "community", "flow", "co_changed_with")})

    def compare(self, base_root: str, head_root: str) -> DataFrame:
        """Declarations added, removed or modified between two trees; ``moved`` tells that only the place differs."""
        sides = []
        for root in (base_root, head_root):
            files = java.scan(self.spark, root).withColumn("project_id", F.lit("diff"))
            sides.append(ingest.manifest(ingest.parse_files(files)))
        found = versions.diff(sides[0], sides[1], ["key"], ["kind", "file", "name", "hash", "line_start", "line_end"])
        moved = (F.col("status") == "modified") & (F.col("base_hash") == F.col("head_hash"))
        return found.withColumn("moved", moved).orderBy("status", "key")

    def compare_refs(self, folder: str, base: str, head: str) -> list:
        shared = shared_dir(self.spark)
        with git.snapshot(folder, base, shared) as a, git.snapshot(folder, head, shared) as b:
            return self.compare(a, b).collect()

    # overlay

    def overlaid(self, documents: DataFrame) -> dict[str, DataFrame]:
        """All tables as readers see them: the index with uncommitted edits over it."""
        t = self.store.tables()
        dirty = stage(overlay.dirty(documents), "overlay-dirty")
        hidden = stage(versions.suppressed(dirty, overlay.deleted(documents)), "overlay-hidden")
        added = dirty.select(F.explode("symbols").alias("s")).select("s.*")
        methods = dirty.select(F.explode("methods").alias("m")).select("m.*")
        new_methods = methods.withColumn("is_constructor", F.lit(False)).withColumn("modifiers", F.array().cast("array<string>")).withColumn("return_type", F.lit(None).cast("string"))
        hidden_methods = self.methods().join(hidden, "file_id", "left_semi").select(F.col("id").alias("node"))
        calls = dirty.select(F.explode("calls").alias("c")).select(F.col("c.src").alias("src_id"), F.col("c.dst").alias("dst_id"), "c.confidence", "c.reason")
        files = dirty.select(F.col("file_id").alias("id"), F.col("rel_path").alias("path"), "project_id", "is_test", F.col("file_hash").alias("hash"))
        classes = methods.select(F.col("class_id").alias("id"), "fqcn", F.substring_index("fqcn", ".", -1).alias("name"), F.lit(None).cast("string").alias("package"), "file_id").distinct()
        base_methods = t["method"].join(hidden_methods.select(F.col("node").alias("id")), "id", "left_anti")
        return t | {
            "symbol": versions.overlaid(t["symbol"], added, hidden),
            "file": versions.overlaid(t["file"].withColumnRenamed("id", "file_id"), files.withColumnRenamed("id", "file_id"), hidden).withColumnRenamed("file_id", "id"),
            "class": versions.overlaid(t["class"], classes, hidden),
            "method": base_methods.unionByName(new_methods.select(*base_methods.columns)),
            "calls": versions.overlaid_edges(t["calls"], calls, hidden_methods),
        }

    def resolve_overlay(self, files: DataFrame) -> tuple[ingest.Parsed, dict[str, DataFrame]]:
        """Edited files (project_id, rel_path, content), parsed, and their edges into the index and one another."""
        parsed = ingest.parse_files(files)
        t = self.store.tables()
        return parsed, ingest.overlay_edges(parsed, ingest.with_classes(t), t["class"])

    def update_overlay(self, folder: str, files: DataFrame, deleted: dict[str, list[str]] | None = None) -> int:
        """Parse edited files, resolve their calls and write them into their projects' overlay documents; number of files.

        Edited files are few; their declarations and calls travel through the driver into one document a project.
        """
        parsed, edges = self.resolve_overlay(files)
        heads = {r.id: (r.path, r.indexed_commit) for r in self.store.table("project").select("id", "path", "indexed_commit").collect()}
        found = ingest.overlay_rows(parsed, edges["calls"]).collect()
        by_project: dict[str, dict] = {}
        for r in found:
            by_project.setdefault(r.project_id, {})[r.rel_path] = r.asDict(recursive=True) | {"file_path": f"{heads.get(r.project_id, ('',))[0]}/{r.rel_path}"}
        for project in {*by_project, *(deleted or {})}:
            path, commit = heads.get(project, ("", None))
            header = {"project_path": path, "base_commit": commit, "current_head": git.head(path) if path else None}
            document = overlay.upsert_files(overlay.read_document(self.spark, folder, project, path), by_project.get(project, {}), **header)
            if gone := (deleted or {}).get(project):
                document = overlay.mark_deleted(document, gone, **header)
            overlay.write_document(self.spark, folder, project, json.dumps(document, default=str))
        self.mark_dirty([*by_project, *(deleted or {})])
        return len(found)

    def edited(self, folder: str, paths: list[str]) -> int:
        """Put files as they now lie on disk into the overlay; missing ones are marked as deleted."""
        gone: dict[str, list[str]] = {}
        rows = []
        for path in paths:
            project = self.infer_project(path)
            if project is not None:
                rows.append((path, project, path[len(self.repo_path(project).rstrip("/")) + 1 :]))
        named = self.spark.createDataFrame(rows, "path string, project_id string, rel_path string")
        read = java.read_files(self.spark, [r[0] for r in rows])
        there = {r.path for r in read.select("path").collect()}
        for path, project, rel in rows:
            if path not in there:
                gone.setdefault(project, []).append(rel)
        return self.update_overlay(folder, named.join(read, "path").select("project_id", "rel_path", "content"), gone)

    def mark_dirty(self, project_ids: list[str], dirty: bool = True) -> None:
        projects = self.store.table("project")
        hit = F.col("id").isin(project_ids) if project_ids else F.lit(False)
        self.store.commit({"project": stage(projects.withColumn("overlay_dirty", F.when(hit, F.lit(dirty)).otherwise(F.col("overlay_dirty"))), "projects")})

    def poll_heads(self, overlay_path: str | None = None) -> list[str]:
        """One look of the head monitor: projects whose head has moved since they were indexed are promoted; their ids."""
        moved = [(r.id, r.path) for r in self.store.table("project").select("id", "path", "indexed_commit").collect() if (now := git.head(r.path)) and now != r.indexed_commit]
        for root in sorted({git.root(path) or path for _, path in moved}):
            self.promote(root, overlay_path)
        return [p for p, _ in moved]

    def promote(self, root: str, overlay_path: str | None = None, require_head_change: bool = True) -> dict[str, int] | None:
        """Fold uncommitted edits into the index once the head has moved; None if there is nothing to do.

        Indexing and clearing repeat without harm, so a promotion that failed half-way is run again.
        """
        now = git.head(root)
        known = {r.indexed_commit for r in self.store.table("project").select("indexed_commit").collect()}
        if now is None or require_head_change and known == {now}:
            return None
        done = self.analyse(root)
        projects = self.store.table("project")
        clean = projects.withColumn("indexed_commit", F.lit(now)).withColumn("indexed_at", F.current_timestamp()).withColumn("overlay_dirty", F.lit(False))
        self.store.commit({"project": clean})
        if overlay_path is not None:
            self.clear_overlay(overlay_path)
        return done

    def clear_overlay(self, overlay_path: str, project: str | None = None) -> None:
        """Drop a project's overlay document (all without a project) and the dirty mark."""
        overlay.clear(self.spark, overlay_path, project)
        projects = self.store.table("project")
        hit = F.lit(True) if project is None else F.col("id") == project
        self.store.commit({"project": projects.withColumn("overlay_dirty", F.when(hit, False).otherwise(F.col("overlay_dirty")))})

    def repo_path(self, project: str) -> str | None:
        """Folder of a project."""
        found = self.store.table("project").where(F.col("id") == project).select("path").first()
        return found.path if found else None

    def infer_project(self, path: str) -> str | None:
        """Project whose folder is the longest prefix of a path."""
        rows = self.store.table("project").select("id", "path").collect()
        found = [(len(r.path), r.id) for r in rows if path == r.path or path.startswith(r.path.rstrip("/") + "/")]
        return max(found)[1] if found else None

    def status(self, now: Column | None = None) -> DataFrame:
        """Age of each project and a warning when it is stale."""
        return versions.staleness(self.store.table("project"), now if now is not None else F.current_timestamp())

    def overlay_status(self, documents: DataFrame) -> DataFrame:
        heads = documents.select("project_id", F.col("current_head").alias("head"))
        return versions.overlay_status(overlay.summary(documents), self.store.table("project"), heads)

    # languages

    def views(self) -> None:
        """Register all tables as views, with the two edge kinds that follow from columns."""
        for name, df in self.store.tables().items():
            df.createOrReplaceTempView(name)
        t = self.store.tables()
        t["symbol"].select(F.col("file_id").alias("src_id"), F.col("id").alias("dst_id")).createOrReplaceTempView("declares")
        t["method"].select(F.col("class_id").alias("src_id"), F.col("id").alias("dst_id")).createOrReplaceTempView("has_method")

    def sql(self, text: str) -> DataFrame:
        self.views()
        return self.spark.sql(text)

    def match(self, text: str, **parameters) -> DataFrame:
        """A read-only graph query over the index."""
        return self.sql(to_sql(text, parameters))
