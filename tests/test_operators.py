"""Operators on tiny tables with results worked out by hand, and random graphs against plain Python."""

from __future__ import annotations

import math
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import community, coupling, deadcode, graph, resolve, search, versions
from tessera.sources import git, workspace
from tessera.streaming import watch

METHOD = "id string, name string, param_count int, class_id string, class_fqcn string"
SITE = "call_id string, source_id string, name string, receiver string, arg_count int, class_id string, class_fqcn string, package string, imports array<string>, local_types map<string,string>, field_types map<string,string>"
EDGE = "src_id long, dst_id long, confidence double, reason string"


def test_resolve_tiers(spark):
    methods = [("m1", "run", 0, "c1", "a.Own"), ("m2", "run", 0, "c2", "a.b.Other"), ("m3", "pay", 1, "c3", "a.Service"), ("m4", "solo", 2, "c4", "z.Far")]
    methods += [(f"h{i}", "hot", 0, f"k{i}", f"y.K{i}") for i in range(13)] + [(f"w{i}", "warm", 0, f"k{i}", f"y.K{i}") for i in range(12)]
    site = lambda i, name, receiver=None, n=0, local=None: (i, f"s{i}", name, receiver, n, "c1", "a.Own", "a", ["q.Imported", "x.y.*"], local or {}, {"f": "Service[]"})
    sites = [site("1", "run", "this"), site("2", "pay", "v", 1, {"v": "Service"}), site("3", "pay", "f", 1), site("4", "run"), site("5", "solo", None, 2), site("6", "hot"), site("7", "warm"), site("8", "println", None, 0), site("9", "solo", "unknown", 2)]
    m = spark.createDataFrame(methods, METHOD)
    classes = m.select(F.col("class_fqcn").alias("fqcn"), F.substring_index("class_fqcn", ".", -1).alias("name")).distinct()
    got = {}
    for r in resolve.resolve_calls(spark.createDataFrame(sites, SITE), m, classes).collect():
        got.setdefault(r.src_id, set()).add((r.dst_id, r.confidence, r.reason))
    assert got["s1"] == {("m1", 1.0, "receiver_this_exact")}
    assert got["s2"] == got["s3"] == {("m3", 0.8, "receiver_method_match")}
    assert got["s4"] == {("m1", 1.0, "intra_class_exact")}
    assert got["s5"] == got["s9"] == {("m4", 1.0, "exact_name_arity_unique")}
    assert len(got["s7"]) == 12 and {x[1:] for x in got["s7"]} == {(0.5, "fuzzy_name_arity_ambiguous")}
    assert "s6" not in got and "s8" not in got


def brute_edges(sites, methods, classes):
    """Tier by tier over all methods, for each site row; the least tier of a call counts."""
    found = {}
    for call, source, name, receiver, n, class_id, own, package, imports, local, field in sites:
        if name in resolve.NOISE:
            continue
        m = [x for x in methods if x[1] == name and x[2] == n]
        tiers = {1: set(), 2: {(x[0], 1.0, "intra_class_exact") for x in m if x[3] == class_id}}
        if receiver == "this":
            tiers[1] = {(x[0], 1.0, "receiver_this_exact") for x in m if x[4] == own}
        elif receiver is not None:
            plain = local.get(receiver, field.get(receiver, receiver)).replace("[]", "")
            simple = plain.split(".")[-1]
            types = {f"{package}.{simple}"} | ({plain} if "." in plain else set()) | {i for i in imports if i.split(".")[-1] == simple} | {i[:-1] + simple for i in imports if i.endswith(".*")}
            types |= {c for c, short in classes if short == simple}
            tiers[1] = {(x[0], 0.8, "receiver_method_match") for x in m if x[4] in types}
        for tier, some in ((3, [x for x in m if x[4].startswith(f"{package}.")]), (4, m)):
            how = (1.0, "exact_name_arity_unique") if len(some) == 1 else (0.5, "fuzzy_name_arity_ambiguous")
            tiers[tier] = {(x[0], *how) for x in some} if len(some) <= resolve.MOST_TARGETS else set()
        for tier, ends in tiers.items():
            if ends:
                found.setdefault((call, source), {}).setdefault(tier, set()).update(ends)
    return {(source, *end) for (_, source), tiers in found.items() for end in tiers[min(tiers)]}


def test_resolve_against_brute_force(spark):
    rng = random.Random(7)
    places = [("c1", "a.Own"), ("c2", "a.b.Own"), ("c3", "a.b.Far"), ("c4", "z.Far"), ("c5", "z.Out.In"), ("c6", "q.Alone")]
    methods = [(f"m{i}", rng.choice("fgh"), rng.randrange(3), *rng.choice(places)) for i in range(60)] + [(f"n{i}", "hot", 0, *places[i % 6]) for i in range(40)]
    methods += methods[:3]
    classes = [("a.Own", "Own"), ("a.b.Own", "Own"), ("a.b.Far", "Far"), ("z.Far", "Far"), ("z.Out.In", "Out.In")]
    receivers = [None, "this", "v", "w", "Own", "Far", "In", "Alone", "q.Alone", "z.Far[]", "Nothing"]
    sites = []
    for i in range(400):
        c, f = rng.choice(places)
        site = (f"k{i}", f"s{i % 90}", rng.choice(["f", "g", "h", "hot", "add"]), rng.choice(receivers), rng.randrange(3), c, f, f.rpartition(".")[0], rng.choice([["q.Alone"], ["z.*", "q.*"], ["z.Out.In"], []]), {"v": "Far[]"}, {"w": "Own"})
        sites += [site] * rng.choice([1, 1, 2])
        if i % 10 == 0:  # the same call once more, found by another tier
            sites.append((*site[:3], None, *site[4:]))
    tables = spark.createDataFrame(sites, SITE), spark.createDataFrame(methods, METHOD), spark.createDataFrame(classes, "fqcn string, name string")
    got = [tuple(r) for r in resolve.resolve_calls(*tables).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_edges(sites, methods, classes)
    assert {x[3] for x in got} == {reason for _, reason in resolve.REASONS.values()}


def test_resolve_shuffles_no_edges(spark):
    """After the last join nothing is grouped or sorted: each of these 300 calls has 300 targets, and 90,000 edges stay where they are made."""
    methods = spark.range(300).selectExpr("concat('m', id) id", "'run' name", "0 param_count", "'c1' class_id", "'a.Own' class_fqcn")
    sites = spark.range(300).selectExpr("concat('k', id) call_id", "concat('s', id) source_id", "'run' name", "cast(null as string) receiver", "0 arg_count", "'c1' class_id", "'a.Own' class_fqcn", "'a' package", "array('x.Y') imports", "map('v', 'x') local_types", "map('v', 'x') field_types")
    edges = resolve.resolve_calls(sites, methods, methods.selectExpr("class_fqcn fqcn", "'Own' name").distinct())
    assert edges.count() == 90_000
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any(x in plan for x in ("Aggregate", "Window", "Sort", "Repartition", "Generate"))


def test_resolve_writes_edges_in_little_space(spark, tmp_path):
    """2,001 calls with 2,003 targets each: written as they come, the 4,008,003 edges take less than a fifth of a byte each."""
    methods = spark.range(2003).selectExpr("id * 37 id", "'run' name", "0 param_count", "'c1' class_id", "'a.Own' class_fqcn")
    sites = spark.range(2001).selectExpr("id * 41 call_id", "id * 41 source_id", "'run' name", "cast(null as string) receiver", "0 arg_count", "'c1' class_id", "'a.Own' class_fqcn", "'a' package", "array('x.Y') imports", "map('v', 'x') local_types", "map('v', 'x') field_types")
    edges = resolve.resolve_calls(sites, methods, methods.selectExpr("class_fqcn fqcn", "'Own' name").distinct())
    edges.write.parquet(str(tmp_path / "edges"))
    written = spark.read.parquet(str(tmp_path / "edges"))
    assert written.count() == written.select("src_id", "dst_id").distinct().count() == 2001 * 2003
    assert sum(f.stat().st_size for f in (tmp_path / "edges").glob("*.parquet")) < 2001 * 2003 / 5


def test_lists_of_the_last_join(spark):
    """Nulls stay, no list is longer than LISTED, and a list holds rows of one way of finding."""
    rows = [(1, i % 2, i if i != 5 else None) for i in range(600)] + [(2, 0, 7)]
    lists = resolve._listed(spark.createDataFrame(rows, "group long, how int, source_id long"), ["how"], "source_id").collect()
    assert sorted((r["group"], r.how, x or -1) for r in lists for x in r.source_id) == sorted((g, h, x or -1) for g, h, x in rows)
    assert max(len(r.source_id) for r in lists) == resolve.LISTED


def test_walks_on_random_graphs(spark):
    rng = random.Random(4)
    for _ in range(3):
        pairs = {(rng.randrange(15), rng.randrange(15)) for _ in range(30)}
        calls = spark.createDataFrame([(a, b, rng.choice([None, 0.5, 1.0]), None) for a, b in pairs], EDGE)
        roots = [0, 1]
        depth = dict.fromkeys(roots, 0)
        for d in range(1, 4):
            for a, b in pairs:
                if depth.get(b) == d - 1 and a not in depth:
                    depth[a] = d
        rows = graph.impact(calls, spark.createDataFrame([(r,) for r in roots], "node long"), 3).collect()
        assert {r.node: r.depth for r in rows} == {n: d for n, d in depth.items() if d}
        for r in rows:
            steps = list(zip(r.path[1:], r.path, strict=False))
            assert set(steps) <= pairs and len(steps) == r.depth and r.path[0] in roots and r.bucket == {1: "1", 2: "2"}.get(r.depth, "3+")
        flows = graph.flows(calls, spark.createDataFrame([(0,)], "node long"), 2).collect()
        want = {0: 0}
        for d in (1, 2):
            for a, b in pairs:
                if want.get(a) == d - 1 and b not in want:
                    want[b] = d
        assert {r.node: r.depth for r in flows} == want


def test_search_parts(spark):
    words = spark.createDataFrame([("SolicitPanFetchAction",), ("get_symbolHTTPServer2x",), (None,), ("é",)], "t string")
    assert [r[0] for r in words.select(T.tokens(F.col("t"))).collect()] == [["solicit", "pan", "fetch", "action"], ["get", "symbol", "http", "server", "2", "x"], [], []]
    docs = spark.createDataFrame([("a", "pay pay now"), ("b", "now"), ("c", "")], "id string, text string")
    got = {r.id: r.score for r in search.bm25(docs, F.col("text"), "pay pay").collect()}
    idf, avg = math.log(1 + (3 - 1 + 0.5) / 1.5), 4 / 3
    assert got["a"] == pytest.approx(2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))) and got["b"] == got["c"] == 0
    assert search.bm25(docs, F.col("text"), "!!").count() == 0
    sim = spark.createDataFrame([("procesPayment", "processPayment"), ("", None), ("x", "yy")], "a string, b string").select(T.similarity(F.col("a"), F.col("b")))
    assert [r[0] for r in sim.collect()] == [pytest.approx(1 - 1 / 14), 1.0, 0.0]
    v = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_ranks_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(search, "RANK_RANGE", 7)
    rows = [(i, float(i % 3)) for i in range(50)]
    got = {r.id: r["rank"] for r in search.ranked(spark.createDataFrame(rows, "id long, score double")).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def test_dead_code_rules(spark):
    schema = "method_id string, name string, signature string, modifiers array<string>, class_fqcn string, is_constructor boolean, is_test boolean, file_path string"
    rows = [
        ("t", "t", "t()", [], "a.A", False, True, "/x/A.java"), ("main", "main", "main(String)", [], "a.A", False, False, "/x/A.java"),
        ("web", "get", "get()", ["@GetMapping(\"/x\")"], "a.A", False, False, "/x/A.java"), ("over", "x", "x()", ["@Override"], "a.A", False, False, "/x/A.java"),
        ("ctor", "A", "A()", [], "a.A", True, False, "/x/A.java"), ("role", "x", "x()", [], "a.PayService", False, False, "/x/A.java"),
        ("path", "x", "x()", [], "a.A", False, False, "/x/services/A.java"), ("hash", "hashCode", "hashCode()", [], "a.A", False, False, "/x/A.java"),
        ("bean", "getX", "getX()", ["public"], "a.A", False, False, "/x/A.java"), ("hook", "valueOf", "valueOf()", [], "a.A", False, False, "/x/A.java"),
        ("base", "x", "x()", [], "a.A", False, False, "/x/A.java"), ("sub", "x", "x()", [], "a.A", False, False, "/x/A.java"),
        ("dead1", "x", "x()", ["private"], "a.A", False, False, "/x/A.java"), ("dead2", "y", "y()", ["public"], "a.A", False, False, "/x/A.java"), ("dead3", "z", "z()", None, "a.A", False, False, "/x/A.java"),
        ("called", "c", "c()", [], "a.A", False, False, "/x/A.java"),
    ]
    calls = spark.createDataFrame([("called",)], "dst_id string")
    over = spark.createDataFrame([("sub", "base")], "src_id string, dst_id string")
    found = {r.method_id: (r.exempt, r.confidence) for r in deadcode.classified(spark.createDataFrame(rows, schema), calls, over).collect()}
    assert {k: v[0] for k, v in found.items() if v[0]} == {
        "t": "test_method", "main": "main_method", "web": "annotation:GetMapping", "over": "annotation:Override", "ctor": "constructor", "role": "class_role", "path": "framework_path",
        "hash": "contract_method", "bean": "bean_accessor", "hook": "reflection_hook", "base": "interface_or_base_contract", "sub": "method_override",
    }
    assert {k: v[1] for k, v in found.items() if not v[0]} == {"dead1": "high", "dead2": "low", "dead3": "medium"}
    strict = {r.method_id for r in deadcode.dead_methods(spark.createDataFrame(rows, schema), calls, over, strict=True).collect()}
    assert strict == {"over", "ctor", "role", "path", "hash", "bean", "hook", "dead1", "dead2", "dead3"}


def test_coupling(spark):
    sets = [("1", x) for x in "ab"] + [("2", x) for x in "ab"] + [("3", x) for x in "abc"] + [("4", "c"), ("4", "c")]
    rows = coupling.coupled(spark.createDataFrame(sets, "change string, item string")).collect()
    assert [(r.a, r.b, r.n_ab, r.strength) for r in rows] == [("a", "b", 3, 1.0)]
    both = coupling.get_coupling(coupling.coupling_edges(spark.createDataFrame(rows)), "b").collect()
    assert [(r.src_id, r.dst_id, r.cochanges) for r in both] == [("b", "a", 3)]


def test_communities(spark):
    symbols = spark.createDataFrame([(i, f"p.q.C{i // 2}#m{i}") for i in range(6)], "id long, fqname string")
    two = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)], "a long, b long")
    found = community.communities(symbols, community.symbol_edges(two, spark.createDataFrame([], EDGE))).collect()
    assert sorted(r.symbol_id for r in found) == list(range(6)) and {r["size"] for r in found} == {3} and {r.cohesion for r in found} == {0.5}
    lone = community.communities(spark.createDataFrame([(1, "a.B"), (2, "c.D")], "id long, fqname string"), two.where("false")).collect()
    assert {r.community_id for r in lone} == {"fallback:1000000"}


def test_overlay_and_diff(spark):
    base = spark.createDataFrame([("f1", "x"), ("f2", "y"), ("f3", "z")], "file_id string, v string")
    hidden = versions.suppressed(base.where("file_id = 'f1'"), base.where("file_id = 'f2'"))
    merged = versions.overlaid(base, spark.createDataFrame([("f1", "new")], "file_id string, v string"), hidden)
    assert sorted((r.file_id, r.v) for r in merged.collect()) == [("f1", "new"), ("f3", "z")]
    head = spark.createDataFrame([("f1", "x"), ("f2", None), ("f4", "n")], "file_id string, v string")
    assert {r.file_id: r.status for r in versions.diff(base, head, ["file_id"], ["v"]).collect()} == {"f2": "modified", "f3": "removed", "f4": "added"}


def test_normalised(spark):
    a = "/* c */ int  f( int x ) { // note\n return x ; }"
    b = "int f(int x){return x;}"
    rows = spark.createDataFrame([(a,), (b,)], "s string").select(T.normalised(F.col("s"))).collect()
    assert rows[0] == rows[1]


def test_watch_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"project_id":"p","path":"%s","op":"%s","content":"%s","ts":"2024-01-01T00:00:%02dZ"}\n'
    (tmp_path / "in" / "1.json").write_text(line % ("A.java", "write", "one", 1) + line % ("A.java", "write", "two", 2) + line % ("B.java", "delete", "", 3))
    for _ in range(2):
        watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "overlay"), str(tmp_path / "check"), available_now=True).awaitTermination(60)
        (tmp_path / "in" / "2.json").write_text(line % ("A.java", "write", "three", 9))
    from tessera.sources.overlay import state

    got = {r.rel_path: (r.op, r.content) for r in state(spark.read.parquet(str(tmp_path / "overlay"))).collect()}
    assert got == {"A.java": ("dirty", "three"), "B.java": ("deleted", None)}


def test_git_log(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init")
    for i in range(3):
        for name in ("a.txt", "b.txt"):
            (tmp_path / name).write_text(str(i))
        run("add", "-A")
        run("commit", "-m", f"c{i}")
    members = coupling.change_sets(git.log_lines(spark, str(tmp_path)), git.MARK)
    assert [(r.a, r.b, r.n_ab) for r in coupling.coupled(members).collect()] == [("a.txt", "b.txt", 3)]
    assert git.head(str(tmp_path)) and git.head("/nonexistent") is None and len(git.recent_commits(str(tmp_path), 2)) == 2
    (tmp_path / "a.txt").write_text("changed\n" * 500)
    assert git.diff_text(str(tmp_path), most_lines=10)["truncated"]


def test_modules(tmp_path, spark):
    for m in ("one", "two"):
        (tmp_path / "p" / m).mkdir(parents=True)
    (tmp_path / "p" / "pom.xml").write_text("<modules><module> one </module><module>two</module><module>gone</module></modules>")
    assert [i for _, i in workspace.project_ids(str(tmp_path / "p"))] == ["p::one", "p::two"]
    files = spark.createDataFrame([("/w/a/x",), ("/w/a/b/y",), ("/q",)], "path string")
    modules = spark.createDataFrame([("/w/a", "A"), ("/w/a/b", "B")], "module_path string, project_id string")
    assert {r.path: r.project_id for r in workspace.to_modules(files, modules).collect()} == {"/w/a/x": "A", "/w/a/b/y": "B", "/q": None}
