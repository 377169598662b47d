"""Traversal of call graphs: impact, flows, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import stage

FLOW_LARGE = 12


def _walk(edges: DataFrame, roots: DataFrame, max_depth: int, keys: list[str]) -> DataFrame:
    """Frontier search along from_id -> to_id; the best discoverer of a level wins: confidence, then path.

    One join a level; what is carried on is one row per vertex (and root). Each level is written, so
    that a lost executor repeats one level and plans don't grow.
    """
    start = roots.select(*keys, F.lit(0).alias("depth"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("edge_type"), F.array("node").alias("path"))
    visited = frontier = stage(start.dropDuplicates(keys), "walk")
    # written once, dealt by where edges start, so that no level computes them again
    moves = edges.select("from_id", "to_id", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("reason", F.lit("unknown")).alias("edge_type"))
    moves = stage(moves, "walk-edges")
    for depth in range(1, max_depth + 1):
        root = [k for k in keys if k != "node"]
        step = frontier.select(*root, F.col("node").alias("from_id"), "path").join(moves, "from_id")
        found = step.select(*root, F.col("to_id").alias("node"), (-F.col("confidence")).alias("minus"), "edge_type", F.concat("path", F.array("to_id")).alias("path"))
        fresh = found.join(visited.select(*keys), keys, "left_anti")
        best = fresh.groupBy(*keys).agg(F.min(F.struct("minus", "path", "edge_type")).alias("b"))
        frontier = stage(
            best.select(*keys, F.lit(depth).alias("depth"), (-F.col("b.minus")).alias("confidence"), F.col("b.edge_type").alias("edge_type"), F.col("b.path").alias("path")), "walk"
        )
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def impact(calls: DataFrame, roots: DataFrame, max_depth: int = 4) -> DataFrame:
    """node, depth, bucket, edge_type, confidence, path: callers of the roots, transitively; roots are left out.

    calls: src_id, dst_id, confidence, reason. roots: node. Depth is the least number of calls;
    confidence is that of the last one; no roots give no rows.
    """
    back = calls.select(F.col("dst_id").alias("from_id"), F.col("src_id").alias("to_id"), "confidence", "reason")
    seen = _walk(back, roots.select("node"), max_depth, ["node"]).where("depth > 0")
    bucket = F.when(F.col("depth") == 1, "1").when(F.col("depth") == 2, "2").otherwise("3+")
    return seen.select("node", "depth", bucket.alias("bucket"), "edge_type", "confidence", "path")


def impact_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("callers"))


def flows(calls: DataFrame, entries: DataFrame, max_depth: int = 6) -> DataFrame:
    """entry, node, depth, kind: what each entry reaches, itself included at depth 0.

    A flow of more than FLOW_LARGE nodes is of kind 'cross_community', else 'intra_community'.
    """
    ahead = calls.select(F.col("src_id").alias("from_id"), F.col("dst_id").alias("to_id"), "confidence", "reason")
    start = entries.select(F.col("node").alias("entry"), "node")
    seen = _walk(ahead, start, max_depth, ["entry", "node"]).select("entry", "node", "depth")
    size = seen.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(size, "entry").select("entry", "node", "depth", F.when(F.col("n") > FLOW_LARGE, "cross_community").otherwise("intra_community").alias("kind"))


def entry_methods(methods: DataFrame, most: int = 10) -> DataFrame:
    """Methods named main and tests; without any, the first few by name."""
    entries = methods.where((F.col("name") == "main") | F.col("is_test")).select(F.col("id").alias("node"))
    return entries if not entries.isEmpty() else methods.orderBy("name", "id").limit(most).select(F.col("id").alias("node"))


def flow_entries(methods: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Entries that a query names: id, name or part of the signature, without regard to case."""
    q = query.lower()
    return methods.where((F.col("id") == query) | (F.lower("name") == q) | F.lower("signature").contains(q)).orderBy("id").limit(most).select(F.col("id").alias("node"))


def neighbourhood(target: str | DataFrame, calls: DataFrame, methods: DataFrame, overrides: DataFrame) -> DataFrame:
    """target, role, node: callers, callees, members of the same class, overridden and overriding methods."""
    spark = calls.sparkSession
    want = target if isinstance(target, DataFrame) else spark.createDataFrame([(target,)], "target string")
    t = want.select("target")

    def along(edges: DataFrame, here: str, there: str, role: str) -> DataFrame:
        return edges.join(t, F.col(here) == F.col("target")).select("target", F.lit(role).alias("role"), F.col(there).alias("node")).distinct()

    own = methods.join(t, F.col("id") == F.col("target")).select("target", "class_id")
    siblings = methods.select("id", "class_id").join(own, "class_id").where("id <> target").select("target", F.lit("sibling").alias("role"), F.col("id").alias("node"))
    out = along(calls, "dst_id", "src_id", "caller").unionByName(along(calls, "src_id", "dst_id", "callee")).unionByName(siblings)
    return out.unionByName(along(overrides, "src_id", "dst_id", "overrides")).unionByName(along(overrides, "dst_id", "src_id", "overridden_by"))


def neighbourhood_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("target", "role").agg(F.count(F.lit(1)).alias("n"))


def with_method_meta(found: DataFrame, methods: DataFrame, classes: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with a ``node`` that is a method: its name, qualified name, class, file and project."""
    c = classes.select(F.col("id").alias("class_id"), "fqcn", "file_id")
    f = files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "project_id")
    m = methods.select(F.col("id").alias("node"), "name", "signature", "class_id").join(c, "class_id").join(f, "file_id")
    return found.join(m.select("node", "name", F.concat("fqcn", F.lit("#"), "signature").alias("fqname"), "fqcn", "file_path", "project_id"), "node", "left")
