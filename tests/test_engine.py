"""A small Java workspace through ingest, search, analyses, overlay and patterns."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import versions
from tessera.plans.engine import Engine
from tessera.plans.match import to_sql
from tessera.sources import overlay
from tessera.sources.java import parse

APP = """package com.example;
public class App {
    public static void main(String[] args) {
        Service service = new Service();
        service.processPayment();
    }
}
"""
SERVICE = """package com.example;
public class Service extends Base implements Payable {
    public void processPayment() { helper(); System.out.println("x, (y"); }
    private void helper() { }
    private void unusedHelper() { }
    public void run() { }
}
"""
BASE = """package com.example;
public class Base { public void run() { } private void lonely() { } }
"""
TEST = """package com.example;
public class ServiceTest {
    @Test public void testProcessPayment() { Service s = new Service(); s.processPayment(); }
}
"""


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    root = tmp_path_factory.mktemp("ws") / "shop"
    main, test = root / "src/main/java/com/example", root / "src/test/java/com/example"
    main.mkdir(parents=True)
    test.mkdir(parents=True)
    (root / "pom.xml").write_text("<project/>")
    for name, text in (("App", APP), ("Service", SERVICE), ("Base", BASE)):
        (main / f"{name}.java").write_text(text)
    (test / "ServiceTest.java").write_text(TEST)
    return root


@pytest.fixture(scope="module")
def engine(spark, workspace, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    done = e.analyse(str(workspace), embed=True)
    assert done["files_indexed"] == 4 and done["class"] == 4 and done["method"] == 8
    return e


def names(engine, ids):
    found = {r.id: f"{r.fqcn}.{r.name}" for r in engine.methods().collect()}
    return sorted(found[i].removeprefix("com.example.") for i in ids)


def test_second_run_indexes_nothing(engine, workspace):
    assert engine.analyse(str(workspace))["files_indexed"] == 0


def test_calls(engine):
    edges = {(*names(engine, [r.src_id]), *names(engine, [r.dst_id]), r.confidence, r.reason) for r in engine.store.table("calls").collect()}
    assert ("App.main", "Service.processPayment", 0.8, "receiver_method_match") in edges
    assert ("Service.processPayment", "Service.helper", 1.0, "intra_class_exact") in edges
    assert len(edges) == 3


def test_search(engine):
    rows = engine.search("process payment").collect()
    assert "processPayment" in [r.name for r in rows[:3]]
    exact = engine.search("processPayment").first()
    assert exact.name == "processPayment" and not exact.low_confidence


def test_impact_and_flow(engine):
    found = engine.impact("helper").collect()
    assert {(r.name, r.depth, r.bucket) for r in found} >= {("processPayment", 1, "1"), ("main", 2, "2"), ("testProcessPayment", 2, "2")}
    assert engine.impact("nothing_like_it").count() == 0
    flows = engine.flows().collect()
    assert {r.depth for r in flows} == {0, 1, 2} and {r.kind for r in flows} == {"intra_community"}


def test_dead_code(engine):
    assert {r.name: r.confidence for r in engine.dead_code().collect()} == {"lonely": "high"}
    strict = {r.name for r in engine.dead_code(strict=True).collect()}
    assert "unusedHelper" in strict and "main" not in strict and "run" not in strict


def test_inheritance(engine):
    assert engine.store.table("implements").count() == 1
    over = engine.store.table("overrides").collect()
    assert [names(engine, [r.src_id, r.dst_id]) for r in over] == [["Base.run", "Service.run"]]


def test_neighbourhood_and_communities(engine):
    target = engine.methods().where("name = 'processPayment'").first().id
    roles = {(r.role, r.name) for r in engine.neighbourhood(target).collect()}
    assert {("caller", "main"), ("caller", "testProcessPayment"), ("callee", "helper"), ("sibling", "unusedHelper")} <= roles
    sizes = engine.store.table("in_community").groupBy("dst_id").count().collect()
    assert sizes and all(r["count"] >= 2 for r in sizes)


def test_stats_and_packages(engine):
    total = engine.stats().where("project_id is null").first()
    assert (total.files, total.classes, total.methods, total.calls_out) == (4, 4, 8, 3)
    assert engine.packages().first().classes == 4
    assert engine.capabilities().first().embedded == 12


def test_patterns(engine):
    rows = engine.match("MATCH (a:Method)-[r:CALLS]->(b:Method) WHERE b.name = $n AND a.name CONTAINS 'main' RETURN a.name AS caller, r.confidence AS c ORDER BY caller LIMIT 5", n="processPayment").collect()
    assert [(r.caller, r.c) for r in rows] == [("main", 0.8)]
    dead = engine.match("MATCH (m:Method) WHERE NOT EXISTS { MATCH (x:Method)-[:CALLS]->(m) } RETURN count(*) AS n").first().n
    assert dead == 8 - 2
    both = engine.match("MATCH (c:Class {name: 'Service'})-[:HAS_METHOD]->(m:Method) OPTIONAL MATCH (m)-[:CALLS]->(t:Method) RETURN m.name AS m, t.name AS t ORDER BY m").collect()
    assert [(r.m, r.t) for r in both] == [("helper", None), ("processPayment", "helper"), ("run", None), ("unusedHelper", None)]
    first = engine.match("MATCH (m:Method) WITH m ORDER BY m.name, m.id LIMIT 2 RETURN m.name AS n").collect()
    assert [r.n for r in first] == ["helper", "lonely"]
    limited = engine.match("MATCH (m:Method) WITH m ORDER BY m.name, m.id LIMIT 3 MATCH (m)<-[:CALLS]-(x:Method) RETURN m.name AS m, x.name AS x").collect()
    assert [(r.m, r.x) for r in limited] == [("helper", "processPayment")]
    degree = engine.match("MATCH (m:Method)-[:CALLS]-(x:Method) WITH m, count(*) AS n WHERE n > 1 RETURN m.name AS m, n ORDER BY m").collect()
    assert [(r.m, r.n) for r in degree] == [("processPayment", 3)]
    listed = engine.match("UNWIND $names AS n MATCH (m:Method) WHERE m.name = n RETURN n, count(*) AS c ORDER BY n", names=["run", "main"]).collect()
    assert [(r.n, r.c) for r in listed] == [("main", 1), ("run", 2)]
    plan = engine.match("MATCH (m:Method)-[:CALLS]-(x:Method) RETURN m.name AS m")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="not supported"):
        to_sql("MATCH (m:Method) DELETE m")


def test_overlay(engine, spark, tmp_path):
    project = engine.store.table("project").first().id
    file = engine.store.table("file").where("path like '%/Service.java'").first()
    doc = {
        "project_id": project, "project_path": "/p", "current_head": "b",
        "dirty_files": {"/p/x": {"file_id": file.id, "symbols": [{"id": "s1", "kind": "class", "name": "Service", "fqname": "com.example.Service", "file_id": file.id}], "calls": [{"src": "n1", "dst": "n2", "confidence": 1.0, "reason": "x"}]}},
        "deleted_files": ["/p/src/test/java/com/example/ServiceTest.java"],
    }
    (tmp_path / "o.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{nope")
    documents = overlay.read_documents(spark, str(tmp_path))
    seen = engine.overlaid(documents)
    fq = {r.fqname for r in seen["symbol"].collect()}
    assert "com.example.Service" in fq and not any("Service#" in f or "ServiceTest" in f for f in fq)
    assert [(r.src_id, r.dst_id) for r in seen["calls"].collect()] == [("n1", "n2")]
    status = engine.overlay_status(documents).first()
    assert status.present and (status.dirty_files, status.deleted_files) == (1, 1) and not status.promotion_pending


def test_compare(engine, workspace, tmp_path):
    other = tmp_path / "src/main/java/com/example"
    other.mkdir(parents=True)
    (other / "Base.java").write_text("package com.example;\n// moved\npublic class Base { public void run() { } public void more() { } }\n")
    (other / "App.java").write_text("\n\n" + APP)
    rows = {r.key: (r.status, r.moved) for r in engine.compare(str(workspace), str(tmp_path)).collect()}
    assert rows["method:com.example.Base#more()"] == ("added", False)
    assert rows["class:com.example.Service"][0] == "removed"
    assert rows["class:com.example.App"] == ("modified", True)


def test_clear_and_reset(spark, workspace, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.analyse(str(workspace), deep=False)
    gone = e.store.table("file").where("path like '%/Service.java'").select("id")
    e.store.clear_files(gone)
    assert e.store.table("calls").count() == 0 and e.store.table("class").count() == 3
    assert e.analyse(str(workspace), deep=False)["calls"] == 3
    e.store.clear_project(e.store.table("project").first().id)
    assert e.store.table("file").count() == 0 and len(e.store.vacuum(1)) >= 2


def test_incremental_parses_changed_files_only(spark, workspace, tmp_path, monkeypatch):
    """One edited file is parsed alone; edges from unchanged files into it stay; clearing a mark writes one table."""
    import shutil

    from tessera.operators import ingest

    root = tmp_path / "shop"
    shutil.copytree(workspace, root)
    e = Engine(spark, str(tmp_path / "index"))
    e.analyse(str(root), deep=False)
    seen, parse_files = [], ingest.parse_files
    monkeypatch.setattr(ingest, "parse_files", lambda files, **o: seen.append(sorted(r.rel_path for r in files.select("rel_path").collect())) or parse_files(files, **o))
    service = root / "src/main/java/com/example/Service.java"
    service.write_text(SERVICE.replace("private void unusedHelper() { }", "public void added() { helper(); }"))
    assert e.analyse(str(root), deep=False)["files_indexed"] == 1
    assert seen == [["src/main/java/com/example/Service.java"]]
    edges = {tuple(names(e, [r.src_id])) + tuple(names(e, [r.dst_id])) for r in e.store.table("calls").collect()}
    assert edges == {("App.main", "Service.processPayment"), ("ServiceTest.testProcessPayment", "Service.processPayment"), ("Service.processPayment", "Service.helper"), ("Service.added", "Service.helper")}
    before = e.store.manifest()
    e.mark_dirty(["shop"])
    after = e.store.manifest()
    assert {t for t in after if after[t] != before.get(t)} == {"project"} and e.store.table("project").first().overlay_dirty
    assert e.store.table("method", e.store.current() - 2).count() == 8
    base = root / "src/main/java/com/example/Base.java"
    base.unlink()
    assert e.reindex_file(str(base))["files_deleted"] == 1 and e.store.table("class").count() == 3
    base.write_text(BASE)
    assert e.reindex_file(str(base))["files_indexed"] == 1 and e.store.table("overrides").count() == 1
    assert e.reindex_file("/elsewhere/X.java") is None and e.repo_path("shop") == str(root)


def test_conflicting_commits(spark, tmp_path, monkeypatch):
    from tessera import schema
    from tessera.sources.store import ConcurrentCommit, GraphStore

    store = GraphStore(spark, str(tmp_path))
    meta = lambda v: spark.createDataFrame([("version", v)], schema.DDL["schema_meta"])
    store.commit({"schema_meta": meta("1")})
    stale = GraphStore(spark, str(tmp_path))
    monkeypatch.setattr(stale, "current", lambda: None)
    with pytest.raises(ConcurrentCommit):
        stale.commit({"schema_meta": meta("2")})
    assert store.table("schema_meta").first().value == "1" and store.snapshots() == [1]
    store.commit({"project": spark.createDataFrame([("o'b", "/p", "java", None, None, False)], schema.DDL["project"])})
    store.clear_project("o'b")
    assert store.table("project").count() == 0 and store.table("schema_meta").first().value == "1"


def test_overlay_reads(spark, workspace, tmp_path):
    """Edited files are parsed and resolved against the index; search, symbols and impact see them; projects become dirty."""
    import shutil

    from tessera.streaming import watch

    root = tmp_path / "shop"
    shutil.copytree(workspace, root)
    e = Engine(spark, str(tmp_path / "index"))
    e.analyse(str(root))
    folder = str(tmp_path / "o")
    (tmp_path / "changes").mkdir()
    edited = SERVICE.replace("private void unusedHelper() { }", "public void freshlyAdded() { helper(); }")
    change = {"project_id": "shop", "path": "src/main/java/com/example/Service.java", "op": "write", "content": edited, "ts": "2024-01-01T00:00:00Z"}
    gone = {"project_id": "shop", "path": "src/test/java/com/example/ServiceTest.java", "op": "delete", "ts": "2024-01-01T00:00:01Z"}
    (tmp_path / "changes/a.json").write_text(json.dumps(change) + "\n" + json.dumps(gone))
    watch.follow(e, str(tmp_path / "changes"), folder, str(tmp_path / "cp"), once=True, poll_heads=False)
    documents = overlay.read_documents(spark, folder)
    assert e.store.table("project").first().overlay_dirty
    assert e.search("freshlyAdded", documents=documents).first().name == "freshlyAdded" and e.search("freshlyAdded").first().name != "freshlyAdded"
    assert {r.name for r in e.find_symbol("freshlyAdded", documents=documents).collect()} == {"freshlyAdded"}
    assert {r.name for r in e.impact("helper", documents=documents).collect()} == {"processPayment", "freshlyAdded"}
    assert not {"unusedHelper", "testProcessPayment"} & {r.name for r in e.methods(e.overlaid(documents)).collect()}
    (tmp_path / "o/broken.json").write_text("{")
    projects = e.store.table("project")
    assert overlay.read_documents(spark, folder, projects).count() == projects.count() == 1
    e.clear_overlay(folder)
    assert overlay.read_documents(spark, folder, projects).first().dirty_files is None and not e.store.table("project").first().overlay_dirty


def test_two_projects_same_name(spark, tmp_path):
    for p, m in (("a", "fromA"), ("b", "fromB")):
        d = tmp_path / "ws" / p / "src/main/java"
        d.mkdir(parents=True)
        (tmp_path / "ws" / p / "pom.xml").write_text("<project/>")
        (d / "App.java").write_text(f"package com.example; class App {{ void {m}() {{ }} }}")
    e = Engine(spark, str(tmp_path / "store"))
    e.analyse(str(tmp_path / "ws"), deep=False)
    assert e.store.table("class").select("id").distinct().count() == 2
    assert e.projects(F.current_timestamp()).count() == 2


def test_parser_survives_anything():
    for source in ("", "class", "class A {", "class A { void f( }", "}}}", '"unclosed', "/* open", "class A { int x = {1,{2}}; void g() { a(b(1,2), c[1]); } }"):
        parse(source, all_types=True)
    found = parse("class A { void g(int[] a, String... b) { x.y(z(1, 2), (p, q) -> r); } }")["classes"][0]["methods"][0]
    assert found["signature"] == "g(int,String)" and {c["name"]: c["arg_count"] for c in found["calls"]} == {"y": 2, "z": 2}


def test_plan(spark):
    current = spark.createDataFrame([("a", 1, 10, "x"), ("b", 2, 10, "y"), ("c", 9, 9, "z"), ("d", 5, 5, "n")], "file_id string, mtime long, size long, digest string")
    stored = spark.createDataFrame([("a", 1, 10, "x", "x"), ("b", 1, 10, "y", "y"), ("c", 1, 1, "q", "q"), ("e", 1, 1, "q", "q")], "file_id string, mtime long, size long, cached_hash string, hash string")
    assert {r.file_id: r.action for r in versions.plan(current, stored).collect()} == {"a": "unchanged", "b": "touched", "c": "changed", "d": "added", "e": "deleted"}
    assert {r.file_id: r.action for r in versions.plan(current, stored, True).collect()}["a"] == "changed"


def test_cli_promotion_and_cache(spark, workspace, tmp_path, capsys):
    import shutil
    import subprocess

    from tessera.cli import main

    root = tmp_path / "shop"
    shutil.copytree(workspace, root)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init")
    run("add", "-A")
    run("commit", "-m", "one")
    e = Engine(spark, str(tmp_path / "index"))
    main(["analyse", str(root), "--embed"], e)
    assert json.loads(capsys.readouterr().out)["files_indexed"] == 4
    cached = e.store.table("embedding_cache").count()
    assert cached == e.store.table("symbol").count() == 12
    states = e.plan(e.source_files(str(root))).groupBy("action").count().collect()
    assert [(r.action, r["count"]) for r in states] == [("unchanged", 4)]
    assert e.infer_project(str(root / "src/x.java")) == "shop" and e.infer_project("/elsewhere") is None
    assert e.promote(str(root)) is None
    overlay.write_document(spark, str(tmp_path / "o"), "shop", json.dumps({"project_id": "shop", "project_path": str(root), "current_head": "x", "deleted_files": ["a"]}))
    assert e.overlay_status(overlay.read_documents(spark, str(tmp_path / "o"))).first().promotion_pending
    (root / "src/main/java/com/example/Base.java").write_text(BASE.replace("lonely", "lonesome"))
    run("commit", "-am", "two")
    assert e.poll_heads(str(tmp_path / "o")) == ["shop"]
    assert e.promote(str(root)) is None and not list((tmp_path / "o").glob("*.json"))
    main(["match", "MATCH (m:Method) WHERE m.name STARTS WITH 'lone' RETURN m.name AS n"], e)
    main(["deadcode"], e)
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[0] == {"n": "lonesome"} and lines[1]["name"] == "lonesome"
    assert e.status().first().warning is None
