"""From parsed files to the property graph's tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import ids
from tessera.functions.text import parameter_count
from tessera.operators import resolve
from tessera.runtime import stage
from tessera.sources import java


def symbol_text(kind: Column, fqname: Column, returns: Column) -> Column:
    """What is embedded of a symbol."""
    return F.when(kind == "class", F.concat(F.lit("class "), fqname)).otherwise(F.concat(F.lit("method "), fqname, F.lit(" returns "), F.coalesce(returns, F.lit(""))))


@dataclass
class Parsed:
    """Tables of a set of files, before any names are resolved."""

    files: DataFrame
    classes: DataFrame
    methods: DataFrame
    symbols: DataFrame
    sites: DataFrame
    types: DataFrame


def parse_files(files: DataFrame, compat_ids: bool = False, **options) -> Parsed:
    """files: project_id, rel_path, content. Sources are parsed once and written; all tables come from that."""
    rows = files.select("project_id", "rel_path", "content")
    keyed = rows.withColumn("file_id", ids.file_id(F.col("project_id"), F.col("rel_path"))).withColumn("scope", ids.scope(F.col("rel_path"))).withColumn("hash", ids.digest(F.col("content")))
    keyed = keyed.withColumn("is_test", ids.is_test_path(F.col("rel_path")))
    parsed = stage(java.parsed(keyed, ["file_id", "project_id", "rel_path", "scope", "hash", "is_test"], **options), "parsed")
    project = None if compat_ids else F.col("project_id")
    file_table = parsed.select(F.col("file_id").alias("id"), F.col("rel_path").alias("path"), "project_id", "is_test", "hash")
    each = parsed.select("file_id", "project_id", "scope", "is_test", "package", "imports", F.explode("classes").alias("c"))
    each = each.withColumn("class_id", ids.class_id(F.col("scope"), F.col("c.fqcn"), project))
    classes = each.select(F.col("class_id").alias("id"), "c.fqcn", "c.name", "package", "file_id", "project_id", "scope", "c.line", "c.col", "c.body_hash").dropDuplicates(["id"])
    inner = each.select("file_id", "project_id", "scope", "is_test", "package", "imports", "class_id", F.col("c.fqcn").alias("class_fqcn"), F.col("c.field_types").alias("field_types"), F.explode("c.methods").alias("m"))
    inner = inner.withColumn("id", ids.method_id(F.col("scope"), F.col("class_fqcn"), F.col("m.signature"), project))
    methods = inner.select(
        "id", "class_id", "class_fqcn", "m.name", "m.signature", "m.return_type", "m.modifiers", "m.is_constructor", "is_test",
        parameter_count(F.col("m.signature")).alias("param_count"), "file_id", "project_id", "scope", "m.line", "m.col", "m.line_end", "m.body_hash",
    ).dropDuplicates(["id"])
    class_symbols = classes.select(ids.symbol_id(F.lit("class"), F.col("scope"), F.col("fqcn"), project).alias("id"), F.lit("class").alias("kind"), "name", F.col("fqcn").alias("fqname"), "file_id", "line", "col", symbol_text(F.lit("class"), F.col("fqcn"), F.lit(None)).alias("text"))
    fqname = F.concat("class_fqcn", F.lit("#"), "signature")
    method_symbols = methods.select(
        ids.symbol_id(F.lit("method"), F.col("scope"), fqname, project).alias("id"), F.lit("method").alias("kind"), "name", fqname.alias("fqname"), "file_id", "line", "col",
        symbol_text(F.lit("method"), fqname, F.col("return_type")).alias("text"),
    )
    sites = inner.select("id", "class_id", "class_fqcn", "package", "imports", F.col("m.local_types").alias("local_types"), "field_types", "file_id", F.posexplode("m.calls").alias("n", "c")).select(
        F.sha1(F.concat_ws(":", "id", "n")).alias("call_id"), F.col("id").alias("source_id"), "c.name", "c.receiver", "c.arg_count", "class_id", "class_fqcn", "package", "imports", "local_types", "field_types", "file_id"
    )
    both = F.concat(
        F.transform("c.extends", lambda t: F.struct(F.lit("extends").alias("relation"), t.alias("type"))), F.transform("c.interfaces", lambda t: F.struct(F.lit("implements").alias("relation"), t.alias("type")))
    )
    types = each.select("class_id", "imports", "package", "file_id", F.explode(both).alias("t")).select("class_id", "t.relation", "t.type", "imports", "package", "file_id")
    return Parsed(file_table, classes, methods, class_symbols.unionByName(method_symbols), sites, types)


def edges(parsed: Parsed, all_methods: DataFrame | None = None, all_classes: DataFrame | None = None) -> dict[str, DataFrame]:
    """calls, implements and overrides of the parsed files, resolved against all methods and classes."""
    methods = parsed.methods if all_methods is None else all_methods
    classes = parsed.classes if all_classes is None else all_classes
    calls = resolve.resolve_calls(parsed.sites, methods, classes)
    implements = resolve.resolve_inheritance(parsed.types, classes)
    return {"calls": calls, "implements": implements, "overrides": resolve.resolve_overrides(implements, methods)}


def tables(parsed: Parsed) -> dict[str, DataFrame]:
    """What parsing alone gives; call sites and type names are kept, so that names can be resolved again without parsing."""
    return {"file": parsed.files, "class": parsed.classes, "method": parsed.methods, "symbol": parsed.symbols, "site": parsed.sites, "type_ref": parsed.types}


def overlay_edges(parsed: Parsed, base_methods: DataFrame, base_classes: DataFrame) -> dict[str, DataFrame]:
    """Edges of edited files: their names mean their own declarations and those of all files that aren't edited."""
    edited = parsed.files.select(F.col("id").alias("file_id"))
    methods = base_methods.join(edited, "file_id", "left_anti").unionByName(parsed.methods, allowMissingColumns=True)
    classes = base_classes.join(edited, "file_id", "left_anti").unionByName(parsed.classes, allowMissingColumns=True)
    return edges(parsed, methods, classes)


def overlay_rows(parsed: Parsed, calls: DataFrame) -> DataFrame:
    """A row for each edited file, as an overlay document holds it: declarations and calls as arrays."""
    by = lambda df, name, columns: df.groupBy("file_id").agg(F.collect_list(F.struct(*columns)).alias(name))
    own = parsed.methods.select(F.col("id").alias("src_id"), "file_id")
    files = parsed.files.select(F.col("id").alias("file_id"), F.col("path").alias("rel_path"), "project_id", "is_test", F.col("hash").alias("file_hash"))
    symbols = by(parsed.symbols, "symbols", ["id", "kind", "name", "fqname", "file_id", "line", "col"])
    methods = by(parsed.methods, "methods", ["id", "class_id", "name", "signature", F.col("class_fqcn").alias("fqcn"), "file_id", "is_test"])
    made = by(calls.join(own, "src_id"), "calls", [F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "confidence", "reason"])
    return files.join(symbols, "file_id", "left").join(methods, "file_id", "left").join(made, "file_id", "left")


def index(files: DataFrame, **options) -> dict[str, DataFrame]:
    """All tables of a full index."""
    parsed = parse_files(files, **options)
    return {**tables(parsed), **edges(parsed)}


def merged(old: dict[str, DataFrame], fresh: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Parsed tables with the files of ``gone`` (file_id) left out and the fresh ones added, staged."""
    by_class = old["class"].join(gone, "file_id", "left_semi").select(F.col("id").alias("class_id"))
    left = {name: old[name].join(gone, "file_id", "left_anti") for name in ("class", "symbol", "site", "type_ref")}
    left["file"] = old["file"].join(gone.select(F.col("file_id").alias("id")), "id", "left_anti")
    left["method"] = old["method"].join(by_class, "class_id", "left_anti")
    out = {}
    for name, df in left.items():
        both = df.unionByName(schema.conform(fresh[name], name)) if name in fresh else df
        out[name] = stage(both.dropDuplicates(["id"]) if name in ("class", "method", "symbol") else both, f"merged-{name}")
    return out


def resolved(parsed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """calls, implements, overrides and references_type of parsed tables, and calls between projects."""
    methods = with_classes(parsed)
    classes = parsed["class"].join(parsed["file"].select(F.col("id").alias("file_id"), "project_id"), "file_id")
    calls = resolve.resolve_calls(parsed["site"], methods, classes)
    implements = stage(resolve.resolve_inheritance(parsed["type_ref"], classes), "implements")
    cross = resolve.cross_module(methods, classes.select("id", "name", "project_id"))
    return {
        "calls": calls.unionByName(cross).dropDuplicates(["src_id", "dst_id", "reason"]), "implements": implements,
        "overrides": resolve.resolve_overrides(implements, methods), "references_type": resolve.resolve_references(parsed["site"], methods, classes),
    }


def with_classes(parsed: dict[str, DataFrame]) -> DataFrame:
    """Methods with what resolution compares: class_fqcn, param_count, file_id, project_id."""
    c = parsed["class"].select(F.col("id").alias("class_id"), F.col("fqcn").alias("class_fqcn"), "file_id")
    f = parsed["file"].select(F.col("id").alias("file_id"), "project_id")
    return parsed["method"].join(c, "class_id").join(f, "file_id").withColumn("param_count", parameter_count(F.col("signature")))


def counters(written: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table, in one job."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in written.items()]
    return {r.name: r.n for r in reduce(DataFrame.unionByName, counted).collect()} if counted else {}


def manifest(parsed: Parsed) -> DataFrame:
    """key, kind, file, name, hash, line_start, line_end of each declaration, for comparing two snapshots."""
    paths = parsed.files.select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    c = parsed.classes.select(F.concat(F.lit("class:"), "fqcn").alias("key"), F.lit("class").alias("kind"), "file_id", "name", F.col("body_hash").alias("hash"), F.col("line").alias("line_start"), F.lit(None).cast("bigint").alias("line_end"))
    m = parsed.methods.select(F.concat(F.lit("method:"), "class_fqcn", F.lit("#"), "signature").alias("key"), F.lit("method").alias("kind"), "file_id", "name", F.col("body_hash").alias("hash"), F.col("line").alias("line_start"), "line_end")
    return c.unionByName(m).join(paths, "file_id").drop("file_id")
