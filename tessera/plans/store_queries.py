"""Queries through the store and the engine: a graph is written from the driver's tables, changed and read back.

Customers are files, orders classes, lines methods; a line calls the first line of the order that
its part numbers. Each query starts from the same snapshot, which is published again, not copied.
"""

from __future__ import annotations

import json
import os
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import ingest, resolve, versions
from tessera.plans.catalog import _sources, _t, query
from tessera.plans.engine import Engine
from tessera.runtime import shared_dir
from tessera.sources import git, overlay, workspace
from tessera.sources.store import ConcurrentCommit, GraphStore
from tessera.streaming import watch

GRAPH_SQL = """project as (select 'n' || n_nationkey as id, '/w/' || n_nationkey as path, n_name as indexed_commit from nation),
file as (select 'f' || c_custkey as id, '/w/' || c_nationkey || '/F' || c_custkey || '.java' as path, 'n' || c_nationkey as project_id, c_mktsegment as hash from customer),
class as (select 'c' || o_orderkey as id, 'p' || (o_orderkey % 50) || '.C' || o_orderkey as fqcn, 'C' || o_orderkey as name, 'f' || o_custkey as file_id from orders),
method as (select 'm' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id, 'c' || l_orderkey as class_id, 'm' || (l_partkey % 100) as name, 'm' || (l_partkey % 100) || '()' as signature, l_returnflag = 'R' as is_test from lineitem),
calls as (select 'm' || a.l_orderkey || '-' || a.l_linenumber || '-' || a.l_partkey || '-' || a.l_suppkey as src_id, 'm' || b.l_orderkey || '-' || b.l_linenumber || '-' || b.l_partkey || '-' || b.l_suppkey as dst_id, case when a.l_quantity >= 25 then 1.0 else 0.5 end as confidence
  from lineitem a join lineitem b on b.l_orderkey = a.l_partkey and b.l_linenumber = 1),
symbol as (select 's' || id as id, 'class' as kind, name, fqcn as fqname, file_id from class union all select 's' || m.id, 'method', m.name, c.fqcn || '#' || m.signature, c.file_id from method m join class c on c.id = m.class_id),
in_community as (select 'sc' || o_orderkey as src_id, o_orderpriority as dst_id from orders),
in_flow as (select 'sc' || a.o_orderkey as src_id, 'flow:' || b.o_orderkey as dst_id from orders a join orders b on b.o_orderkey = a.o_orderkey - a.o_orderkey % 100),
co_changed_with as (select 'f' || a.c_custkey as src_id, 'f' || b.c_custkey as dst_id from customer a join customer b on b.c_custkey = a.c_custkey + 1),
file_state as (select id as file_id, hash as cached_hash from file)"""

_first: dict[tuple[str, str], tuple[str, int]] = {}


def graph_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    n, c, o, line = (_t(spark, d, x) for x in ("nation", "customer", "orders", "lineitem"))
    text = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    method_id = F.concat(F.lit("m"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    name = F.concat(F.lit("m"), F.col("l_partkey") % 100)
    package = F.concat(F.lit("p"), F.col("o_orderkey") % 50)
    files = c.select(text("f", "c_custkey").alias("id"), F.concat(F.lit("/w/"), "c_nationkey", F.lit("/F"), "c_custkey", F.lit(".java")).alias("path"), text("n", "c_nationkey").alias("project_id"), (F.col("c_custkey") % 5 == 0).alias("is_test"), F.col("c_mktsegment").alias("hash"))
    classes = o.select(text("c", "o_orderkey").alias("id"), F.concat(package, F.lit(".C"), "o_orderkey").alias("fqcn"), text("C", "o_orderkey").alias("name"), package.alias("package"), text("f", "o_custkey").alias("file_id"))
    methods = line.select(method_id.alias("id"), text("c", "l_orderkey").alias("class_id"), name.alias("name"), F.concat(name, F.lit("()")).alias("signature"), F.lit("void").alias("return_type"), (F.col("l_returnflag") == "R").alias("is_test"), F.lit(False).alias("is_constructor"))
    firsts = line.where("l_linenumber = 1").select(F.col("l_orderkey").alias("l_partkey"), method_id.alias("dst_id"))
    calls = line.select("l_partkey", method_id.alias("src_id"), F.when(F.col("l_quantity") >= 25, 1.0).otherwise(0.5).alias("confidence")).join(firsts, "l_partkey").select("src_id", "dst_id", "confidence", F.lit("line").alias("reason"))
    by_class = classes.select(F.col("id").alias("class_id"), "fqcn", "file_id")
    method_symbols = methods.join(by_class, "class_id").select(F.concat(F.lit("s"), "id").alias("id"), F.lit("method").alias("kind"), "name", F.concat("fqcn", F.lit("#"), "signature").alias("fqname"), "file_id")
    hundreds = o.where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("h"))
    in_flow = o.withColumn("h", F.col("o_orderkey") - F.col("o_orderkey") % 100).join(hundreds, "h").select(text("sc", "o_orderkey").alias("src_id"), text("flow:", "h").alias("dst_id"), F.lit(0).alias("depth"))
    return {
        "project": n.select(text("n", "n_nationkey").alias("id"), text("/w/", "n_nationkey").alias("path"), F.lit("java").alias("language"), F.col("n_name").alias("indexed_commit"), F.lit(False).alias("overlay_dirty")),
        "file": files, "class": classes, "method": methods, "calls": calls, "in_flow": in_flow,
        "symbol": classes.select(F.concat(F.lit("s"), "id").alias("id"), F.lit("class").alias("kind"), "name", F.col("fqcn").alias("fqname"), "file_id").unionByName(method_symbols),
        "community": o.select(F.col("o_orderpriority").alias("id"), F.col("o_orderpriority").alias("label"), F.lit(0.5).alias("cohesion")).distinct(),
        "in_community": o.select(text("sc", "o_orderkey").alias("src_id"), F.col("o_orderpriority").alias("dst_id")),
        "flow": hundreds.select(text("flow:", "h").alias("id"), text("sc", "h").alias("entry_symbol_id"), F.lit("intra_community").alias("kind")),
        "co_changed_with": c.select(text("f", "c_custkey").alias("src_id"), (F.col("c_custkey") + 1).alias("k")).join(c.select(F.col("c_custkey").alias("k")), "k", "left_semi").select("src_id", text("f", "k").alias("dst_id"), F.lit(0.5).alias("strength"), F.lit(3).alias("cochanges"), F.lit(6).alias("months")),
        "file_state": files.select(F.col("id").alias("file_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime"), F.lit(1).alias("size"), F.col("hash").alias("cached_hash")),
    }


def engine_of(spark: SparkSession, d: str) -> Engine:
    """An engine over the graph as first written."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _first:
        path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        _first[key] = (path, GraphStore(spark, path).commit(graph_tables(spark, d)))
    path, number = _first[key]
    engine = Engine(spark, path)
    if engine.store.current() != number:
        engine.store.restore(number)
    return engine


COUNTED = ("project", "file", "class", "method", "symbol", "calls", "community", "in_community", "flow", "in_flow", "co_changed_with", "file_state")


def counts(engine: Engine) -> DataFrame:
    t = engine.store.tables()
    found = ingest.counters({n: t[n] for n in COUNTED})
    return engine.spark.createDataFrame(sorted(found.items()), "name string, n bigint")


def counts_sql(files: str, project: str = "true", analysis: bool = True) -> str:
    """Rows of every table when only some files are left."""
    return f"""with {GRAPH_SQL}, f as (select * from file where {files}), c as (select * from class where file_id in (select id from f)), m as (select * from method where class_id in (select id from c)),
    s as (select * from symbol where file_id in (select id from f)), ic as (select * from in_community where src_id in (select id from s) and {analysis}), il as (select * from in_flow where src_id in (select id from s) and {analysis})
    select 'project' as name, count(*) as n from project where {project} union all select 'file', count(*) from f union all select 'class', count(*) from c union all select 'method', count(*) from m union all select 'symbol', count(*) from s
    union all select 'calls', count(*) from calls where src_id in (select id from m) and dst_id in (select id from m) union all select 'community', count(distinct dst_id) from ic union all select 'in_community', count(*) from ic
    union all select 'flow', count(distinct dst_id) from il union all select 'in_flow', count(*) from il
    union all select 'co_changed_with', count(*) from co_changed_with where src_id in (select id from f) and dst_id in (select id from f) and {analysis} union all select 'file_state', count(*) from file_state where file_id in (select id from f)"""


@query("src_node_scan", f"with {GRAPH_SQL} select id, class_id, name, signature, is_test from method")
def _(spark, d):
    return engine_of(spark, d).store.table("method").select("id", "class_id", "name", "signature", "is_test")


@query("src_rel_scan", f"with {GRAPH_SQL} select src_id, dst_id, confidence, 'line' as reason from calls")
def _(spark, d):
    return engine_of(spark, d).store.table("calls")


@query("sink_clear_file", counts_sql("hash <> 'BUILDING'"))
def _(spark, d):
    e = engine_of(spark, d)
    e.store.clear_files(e.store.table("file").where("hash = 'BUILDING'"))
    return counts(e)


@query("sink_clear_project", counts_sql("project_id <> 'n3'", "id <> 'n3'"))
def _(spark, d):
    e = engine_of(spark, d)
    e.store.clear_project("n3")
    return counts(e)


@query("sink_clear_analysis", counts_sql("true", analysis=False))
def _(spark, d):
    e = engine_of(spark, d)
    e.store.clear_analysis()
    return counts(e)


@query("sink_rebuild", f"with {GRAPH_SQL} select 'project' as name, count(*) as n from project union all select unnest(['file', 'class', 'method', 'symbol', 'calls', 'community', 'in_community', 'flow', 'in_flow', 'co_changed_with', 'file_state']), 0")
def _(spark, d):
    e = engine_of(spark, d)
    project = e.store.table("project")
    e.store.reset()
    e.store.commit({"project": project})
    return counts(e)


@query("sink_snapshot", f"with {GRAPH_SQL} select 'before' as snapshot, language, count(*) as n from (select 'java' as language from project) group by all union all select 'after', 'scala', count(*) from project")
def _(spark, d):
    e = engine_of(spark, d)
    before = e.store.current()
    after = e.store.commit({"project": e.store.table("project").withColumn("language", F.lit("scala"))})
    read = lambda number, name: e.store.table("project", number).groupBy("language").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("snapshot"), "language", "n")
    return read(before, "before").unionByName(read(after, "after"))


@query("sink_transaction", f"with {GRAPH_SQL} select 'published' as writer, 'scala' as language, count(*) as n from project union all select 'refused', 'scala', count(*) from project")
def _(spark, d):
    """Of two writers that start from one snapshot the second is refused, and leaves nothing that is read."""
    e = engine_of(spark, d)
    number, project, spent = e.store.current(), e.store.table("project"), GraphStore(spark, e.store.path)
    spent.current = lambda: number
    e.store.commit({"project": project.withColumn("language", F.lit("scala"))})
    refused = "published"
    try:
        spent.commit({"project": project.withColumn("language", F.lit("cobol"))})
    except ConcurrentCommit:
        refused = "refused"
    now = e.store.table("project").groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return now.select(F.explode(F.array(F.lit("published"), F.lit(refused))).alias("writer"), "language", "n")


@query("ss_hot_reload", f"with {GRAPH_SQL} select 'held' as reader, count(*) as n from file union all select 'new', count(*) from file where project_id <> 'n3'")
def _(spark, d):
    """A reader's tables stay as they were; one that reads after a commit sees it."""
    e = engine_of(spark, d)
    held = e.store.tables()["file"]
    e.store.clear_project("n3")
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("reader"), "n")
    return size(held, "held").unionByName(size(e.store.tables()["file"], "new"))


@query("sink_set_community", f"with {GRAPH_SQL} select src_id, case when cast(substr(src_id, 3) as int) % 7 = 0 then 'moved' else dst_id end as dst_id from in_community")
def _(spark, d):
    e = engine_of(spark, d)
    old = e.store.table("in_community")
    moved = old.where("cast(substring(src_id, 3) as int) % 7 = 0").withColumn("dst_id", F.lit("moved"))
    e.store.commit({"in_community": versions.upsert(old, moved, ["src_id"])})
    return e.store.table("in_community")


@query("sink_set_flow", f"with {GRAPH_SQL} select src_id, dst_id, case when cast(substr(src_id, 3) as int) % 7 = 0 then 4 else 0 end as depth from in_flow")
def _(spark, d):
    e = engine_of(spark, d)
    old = e.store.table("in_flow")
    e.store.commit({"in_flow": versions.upsert(old, old.where("cast(substring(src_id, 3) as int) % 7 = 0").withColumn("depth", F.lit(4).cast("bigint")), ["src_id", "dst_id"])})
    return e.store.table("in_flow")


@query("sink_upsert_coupling", f"with {GRAPH_SQL} select src_id, dst_id, case when cast(substr(src_id, 2) as int) % 7 = 0 then 0.9 else 0.5 end as strength from co_changed_with union all select 'fx', 'fy', 0.9")
def _(spark, d):
    e = engine_of(spark, d)
    old = e.store.table("co_changed_with")
    more = old.where("cast(substring(src_id, 2) as int) % 7 = 0").withColumn("strength", F.lit(0.9)).unionByName(spark.createDataFrame([("fx", "fy", 0.9, 5, 6)], schema.DDL["co_changed_with"]))
    e.store.commit({"co_changed_with": versions.upsert(old, more, ["src_id", "dst_id"])})
    return e.store.table("co_changed_with").select("src_id", "dst_id", "strength")


@query("sink_meta_cache", f"with {GRAPH_SQL} select file_id, case when cached_hash = 'BUILDING' then 'new' else cached_hash end as cached_hash from file_state")
def _(spark, d):
    e = engine_of(spark, d)
    old = e.store.table("file_state")
    e.store.commit({"file_state": versions.upsert(old, old.where("cached_hash = 'BUILDING'").withColumn("cached_hash", F.lit("new")), ["file_id"])})
    return e.store.table("file_state").select("file_id", "cached_hash")


@query("sink_project_meta", f"with {GRAPH_SQL} select id, path, indexed_commit, id in ('n1', 'n2') as overlay_dirty from project")
def _(spark, d):
    e = engine_of(spark, d)
    e.mark_dirty(["n1", "n2"])
    return e.store.table("project").select("id", "path", "indexed_commit", "overlay_dirty")


@query("src_project_meta", f"with {GRAPH_SQL} select p.id as project_id, count(distinct f.id) as files, count(s.id) as symbols from project p left join file f on f.project_id = p.id left join symbol s on s.file_id = f.id group by 1")
def _(spark, d):
    return engine_of(spark, d).projects().select("project_id", "files", "symbols")


@query("src_repo_path", f"with {GRAPH_SQL} select id, path from project where id = 'n3'")
def _(spark, d):
    return spark.createDataFrame([("n3", engine_of(spark, d).repo_path("n3"))], "id string, path string")


@query("src_infer_project", f"with {GRAPH_SQL} select '/w/3/F1.java' as path, id as project_id from project where path = '/w/3' union all select '/elsewhere/F1.java', null")
def _(spark, d):
    e = engine_of(spark, d)
    return spark.createDataFrame([(p, e.infer_project(p)) for p in ("/w/3/F1.java", "/elsewhere/F1.java")], "path string, project_id string")


@query("flt_eq", f"with {GRAPH_SQL} select id, class_id from method where name = 'm7'")
def _(spark, d):
    return engine_of(spark, d).match("MATCH (m:Method {name: 'm7'}) RETURN m.id AS id, m.class_id AS class_id")


@query("flt_param", f"with {GRAPH_SQL} select id, name from method where name in ('m7', 'm8') and is_test")
def _(spark, d):
    return engine_of(spark, d).match("MATCH (m:Method) WHERE m.is_test = $test AND m.name IN $names RETURN m.id AS id, m.name AS name", test=True, names=["m7", "m8"])


@query("flt_optional_project", f"with {GRAPH_SQL} select 'n3' as project, count(*) as n from symbol s join file f on f.id = s.file_id where project_id = 'n3' union all select null, count(*) from symbol")
def _(spark, d):
    e = engine_of(spark, d)
    size = lambda p: e.symbols(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).cast("string").alias("project"), "n")
    return size("n3").unionByName(size(None))


@query("jn_rel_pattern", f"with {GRAPH_SQL} select a.name as class, b.name as called, r.confidence from class a join method m on m.class_id = a.id join calls r on r.src_id = m.id join method t on t.id = r.dst_id join class b on b.id = t.class_id where r.confidence > 0.5")
def _(spark, d):
    return engine_of(spark, d).match("MATCH (a:Class)-[:HAS_METHOD]->(m:Method)-[r:CALLS]->(t:Method)<-[:HAS_METHOD]-(b:Class) WHERE r.confidence > 0.5 RETURN a.name AS class, b.name AS called, r.confidence AS confidence")


@query("jn_undirected_pattern", f"with {GRAPH_SQL}, u as (select src_id as a, dst_id as b from calls union all select dst_id, src_id from calls where src_id <> dst_id) select a as id, count(*) as n from u group by 1")
def _(spark, d):
    return engine_of(spark, d).match("MATCH (m:Method)-[:CALLS]-(x:Method) RETURN m.id AS id, count(*) AS n")


@query("jn_hash_lookup", f"with {GRAPH_SQL} select m.id, c.fqcn || '#' || m.signature as fqname, f.path as file_path, f.project_id from method m join class c on c.id = m.class_id join file f on f.id = c.file_id")
def _(spark, d):
    return engine_of(spark, d).methods().select("id", "fqname", "file_path", "project_id")


@query("so_with_order_limit", f"with {GRAPH_SQL}, m as (select * from method order by name, id limit 40) select m.id, x.id as caller from m join calls on dst_id = m.id join method x on x.id = src_id union all select m.id, null from m where id not in (select dst_id from calls)")
def _(spark, d):
    return engine_of(spark, d).match("MATCH (m:Method) WITH m ORDER BY m.name, m.id LIMIT 40 OPTIONAL MATCH (x:Method)-[:CALLS]->(m) RETURN m.id AS id, x.id AS caller")


@query(
    "gr_context",
    f"""with recursive {GRAPH_SQL}, walk as (select id as node, 0 as depth from (select id from method where name = 'm7' order by id limit 50) union select src_id, depth + 1 from walk join calls on dst_id = node where depth < 3)
    select min(depth) as depth, node from walk group by node having min(depth) > 0""",
)
def _(spark, d):
    return engine_of(spark, d).impact("m7", 3).select(F.col("depth").cast("int").alias("depth"), "node")


# overlay documents: customers whose number ends in 1 are edited, in 2 deleted


def _documents(spark: SparkSession, d: str) -> tuple[Engine, str]:
    e, folder = engine_of(spark, d), f"{shared_dir(spark)}/overlay-{uuid.uuid4().hex}"
    rows = _t(spark, d, "customer").select("c_custkey", "c_nationkey").collect()  # a document a project
    for n in sorted({r.c_nationkey for r in rows}):
        own = [r.c_custkey for r in rows if r.c_nationkey == n]
        path = lambda k: f"F{k}.java"
        document = overlay.read_document(spark, folder, f"n{n}", f"/w/{n}")
        document = overlay.upsert_files(document, {path(k): {"file_id": f"f{k}", "rel_path": path(k)} for k in own if k % 10 == 1}, current_head="x")
        overlay.write_document(spark, folder, f"n{n}", json.dumps(overlay.mark_deleted(document, [path(k) for k in own if k % 10 == 2])))
    return e, folder


DOCUMENTS_SQL = "select 'n' || n_nationkey as project_id, count(*) filter (where {0}) as dirty_files, count(*) filter (where {1}) as deleted_files from nation left join customer on c_nationkey = n_nationkey group by 1"


def _summary(e: Engine, folder: str) -> DataFrame:
    return overlay.summary(overlay.read_documents(e.spark, folder, e.store.table("project")))


@query("src_overlay_json", DOCUMENTS_SQL.format("c_custkey % 10 = 1", "c_custkey % 10 = 2"))
def _(spark, d):
    return _summary(*_documents(spark, d))


@query("sink_overlay_upsert", DOCUMENTS_SQL.format("c_custkey % 10 = 1 or c_custkey % 10 = 2 and n_nationkey = 3", "c_custkey % 10 = 2 and n_nationkey <> 3"))
def _(spark, d):
    e, folder = _documents(spark, d)
    document = overlay.read_document(spark, folder, "n3")
    overlay.write_document(spark, folder, "n3", json.dumps(overlay.upsert_files(document, {p: {"file_id": p, "rel_path": p} for p in document["deleted_files"]})))
    return _summary(e, folder)


@query("sink_overlay_mark_deleted", DOCUMENTS_SQL.format("c_custkey % 10 = 1 and n_nationkey <> 3", "c_custkey % 10 = 2 or c_custkey % 10 = 1 and n_nationkey = 3"))
def _(spark, d):
    e, folder = _documents(spark, d)
    document = overlay.read_document(spark, folder, "n3")
    overlay.write_document(spark, folder, "n3", json.dumps(overlay.mark_deleted(document, list(document["dirty_files"]))))
    return _summary(e, folder)


@query("ss_clear", DOCUMENTS_SQL.format("c_custkey % 10 = 1 and n_nationkey <> 3", "c_custkey % 10 = 2 and n_nationkey <> 3"))
def _(spark, d):
    e, folder = _documents(spark, d)
    e.clear_overlay(folder, "n3")
    return _summary(e, folder)


@query("ss_watch", "select 'p' || (user_id % 3) as project_id, count(*) as files, count(*) filter (where last = 'error') as deleted from (select user_id, max_by(event_type, ts) as last from events group by 1) group by 1")
def _(spark, d):
    base = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
    rows = _t(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id") % 3).alias("project_id"), F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("op"), F.col("props").alias("content"), F.col("ts").cast("timestamp").alias("ts"))
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{base}/changes")
    watch.watch(spark, f"{base}/changes", f"{base}/overlay", f"{base}/checkpoint", available_now=True).awaitTermination()
    state = overlay.state(spark.read.parquet(f"{base}/overlay").drop("batch"))
    return state.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("op") == "deleted").alias("deleted"))


# source text


def _typed_sources(spark, d):
    k = F.col("p_partkey")
    name = lambda i: F.concat(F.lit("C"), i.cast("string"))
    text = F.concat(F.lit("package q;\nimport java.util.List;\npublic class "), name(k), F.lit(" extends "), name(k + 1), F.lit(" implements Runnable, q."), name(k + 2), F.lit(" {\n  "), name(k + 1), F.lit(" peer;\n  public void run() { "), name(k + 2), F.lit(" other = null; other.run(); }\n}\n"))
    return _t(spark, d, "part").select(F.lit("demo").alias("project_id"), F.concat(F.lit("src/main/java/q/"), name(k), F.lit(".java")).alias("rel_path"), F.encode(text, "UTF-8").alias("content"))


def _named(parsed, edges, ends):
    c = parsed.classes.select("id", F.col("name").alias("n")) if ends == "class" else None
    m = parsed.methods.select("id", F.concat_ws(".", F.substring_index("class_fqcn", ".", -1), "name").alias("n"))
    a, b = {"class": (c, c), "method": (m, m), "mixed": (m, parsed.classes.select("id", F.col("name").alias("n")))}[ends]
    return edges.join(a.select(F.col("id").alias("src_id"), F.col("n").alias("src")), "src_id").join(b.select(F.col("id").alias("dst_id"), F.col("n").alias("dst")), "dst_id")


@query("res_implements", "select 'C' || a.p_partkey as src, 'C' || b.p_partkey as dst, case when b.p_partkey = a.p_partkey + 1 then 0.8 else 1.0 end as confidence from part a join part b on b.p_partkey in (a.p_partkey + 1, a.p_partkey + 2)")
def _(spark, d):
    parsed = ingest.parse_files(_typed_sources(spark, d))
    return _named(parsed, resolve.resolve_inheritance(parsed.types, parsed.classes), "class").select("src", "dst", "confidence")


@query("ing_inheritance", "select 'q.C' || p_partkey as fqcn, unnest(['extends C' || (p_partkey + 1), 'implements Runnable', 'implements C' || (p_partkey + 2)]) as relation from part")
def _(spark, d):
    parsed = ingest.parse_files(_typed_sources(spark, d))
    classes = parsed.classes.select(F.col("id").alias("class_id"), "fqcn")
    return parsed.types.join(classes, "class_id").select("fqcn", F.concat_ws(" ", "relation", F.substring_index("type", ".", -1)).alias("relation"))


@query("sink_add_reference", "select 'C' || a.p_partkey || '.run' as src, 'C' || b.p_partkey as dst, 1.0 as confidence from part a join part b on b.p_partkey in (a.p_partkey + 1, a.p_partkey + 2)")
def _(spark, d):
    parsed = ingest.parse_files(_typed_sources(spark, d))
    return _named(parsed, resolve.resolve_references(parsed.sites, parsed.methods, parsed.classes), "mixed").select("src", "dst", "confidence")


@query("ing_symbol_text", "select unnest(['class q.C' || p_partkey, 'method q.C' || p_partkey || '#run() returns void']) as text from part")
def _(spark, d):
    return ingest.parse_files(_typed_sources(spark, d)).symbols.select("text")


@query("gr_manifest_key", "select unnest(['class:q.C' || p_partkey, 'method:q.C' || p_partkey || '#run()']) as key, 'src/main/java/q/C' || p_partkey || '.java' as file from part")
def _(spark, d):
    return ingest.manifest(ingest.parse_files(_typed_sources(spark, d))).select("key", "file")


@query(
    "ing_index_result",
    """select unnest(['file', 'class', 'method', 'symbol', 'site', 'type_ref', 'implements', 'overrides', 'calls']) as name, unnest([n, n, n, 2 * n, n, 3 * n, one + two, one + two, n]) as n
    from (select count(*) as n, (select count(*) from part a join part b on b.p_partkey = a.p_partkey + 1) as one, (select count(*) from part a join part b on b.p_partkey = a.p_partkey + 2) as two from part)""",
)
def _(spark, d):
    found = ingest.counters(ingest.index(_typed_sources(spark, d)))
    return spark.createDataFrame(sorted(found.items()), "name string, n bigint")


@query("ing_catalog_rebuild", "select 'C' || a.p_partkey || '.run' as src, 'C' || b.p_partkey || '.run' as dst, 'receiver_method_match' as reason from part a join part b on b.p_partkey = a.p_partkey + 2 where a.p_partkey % 10 <> 3 and b.p_partkey % 10 <> 3")
def _(spark, d):
    """A third of the way: some files go, and names are resolved again from the parsed tables of the others."""
    parsed = ingest.parse_files(_typed_sources(spark, d))
    fresh = ingest.tables(parsed)
    gone = parsed.files.where("path rlike '3.java$'").select(F.col("id").alias("file_id"))
    left = ingest.merged({n: schema.conform(df, n) for n, df in fresh.items()}, {}, gone)
    return _named(parsed, ingest.resolved(left)["calls"], "method").where("reason = 'receiver_method_match'").select("src", "dst", "reason")


@query("res_overlay_resolve", "select 'C' || a.p_partkey || '.run' as src, 'C' || b.p_partkey || '.go' || b.p_partkey as dst, 'receiver_method_match' as reason from part a join part b on b.p_partkey = a.p_partkey + 1 where a.p_partkey % 10 = 0")
def _(spark, d):
    """Files of every tenth part are edited: their calls meet the index's methods of the others."""
    sources = _sources(spark, d)
    edited = F.regexp_extract("rel_path", r"C(\d+)\.java$", 1).cast("long") % 10 == 0
    base, edits = ingest.parse_files(sources), ingest.parse_files(sources.where(edited))
    found = ingest.overlay_edges(edits, base.methods, base.classes)["calls"]
    return _named(base, found, "method").where("reason = 'receiver_method_match'").select("src", "dst", "reason")


# a workspace on disk: a project for each region, a module for each nation


def _workspace(spark: SparkSession, d: str, commit: bool = False) -> str:
    root = f"{shared_dir(spark).removeprefix('file://')}/workspace-{uuid.uuid4().hex}"
    rows = _t(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()
    for r in sorted({x.n_regionkey for x in rows}):
        own = [x.n_nationkey for x in rows if x.n_regionkey == r]
        os.makedirs(f"{root}/r{r}")
        with open(f"{root}/r{r}/pom.xml", "w") as f:
            f.write("<project>" + "".join(f"<module>n{n}</module>" for n in own) + "</project>")
        for n in own:
            os.makedirs(f"{root}/r{r}/n{n}/src/main/java")
            with open(f"{root}/r{r}/n{n}/src/main/java/N{n}.java", "w") as f:
                f.write(f"class N{n} {{ void go() {{ }} }}\n")
    if commit:
        run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
        run("init", "-q")
        run("add", "-A")
        run("commit", "-qm", "all nations")
    return root


@query("src_java_scan", "select 'r' || n_regionkey || '::n' || n_nationkey as project_id, 'src/main/java/N' || n_nationkey || '.java' as rel_path, cast(length('class N { void go() { } }') + length(n_nationkey::varchar) + 1 as bigint) as size from nation")
def _(spark, d):
    return Engine(spark, f"{shared_dir(spark)}/none").source_files(_workspace(spark, d)).select("project_id", "rel_path", "size")


@query("src_workspace", "select distinct 'r' || n_regionkey as project from nation")
def _(spark, d):
    return spark.createDataFrame([(os.path.basename(p),) for p in workspace.projects_in(_workspace(spark, d))], "project string")


@query("src_project_ids", "select 'n' || n_nationkey as module, 'r' || n_regionkey || '::n' || n_nationkey as project_id from nation")
def _(spark, d):
    return spark.createDataFrame([(os.path.basename(m), p) for m, p in workspace.project_ids(_workspace(spark, d))], "module string, project_id string")


@query("src_git_head", "select 40 as head_length, true as same_root, 1 as commits, 'all nations' as subject, (select count(*) from nation) + (select count(distinct n_regionkey) from nation) as files")
def _(spark, d):
    root = _workspace(spark, d, commit=True)
    log = git.recent_commits(root)
    lines = git.log_lines(spark, root).where("line <> '' and not startswith(line, 'commit ')").count()
    return spark.createDataFrame([(len(git.head(root) or ""), os.path.realpath(git.root(root) or "") == os.path.realpath(root), len(log), log[0]["subject"], lines)], "head_length int, same_root boolean, commits int, subject string, files bigint")


@query("src_git_worktree", "select 'src/main/java/N' || n_nationkey || '.java' as file, 'removed' as status from nation where n_nationkey = 3")
def _(spark, d):
    """A tree of a ref is read while the folder has moved on."""
    root = _workspace(spark, d, commit=True)
    region = next(r for r in os.listdir(root) if os.path.isdir(f"{root}/{r}/n3"))
    os.remove(f"{root}/{region}/n3/src/main/java/N3.java")
    with git.snapshot(root, "HEAD", shared_dir(spark)) as tree:
        then = {os.path.relpath(os.path.join(a, f), tree) for a, _, files in os.walk(tree) for f in files if f.endswith(".java")}
    now = {os.path.relpath(os.path.join(a, f), root) for a, _, files in os.walk(root) for f in files if f.endswith(".java")}
    return spark.createDataFrame([("/".join(f.split("/")[2:]), "removed") for f in sorted(then - now)], "file string, status string")
