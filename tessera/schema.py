"""Explicit schemas of the property graph's node and edge tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "4"
VECTOR_DIM = 384

DDL = {
    "schema_meta": "key string, value string",
    "project": "id string, path string, language string, indexed_at timestamp, indexed_commit string, overlay_dirty boolean",
    "file": "id string, path string, project_id string, is_test boolean, hash string",
    "class": "id string, fqcn string, name string, package string, file_id string",
    "method": "id string, class_id string, name string, signature string, return_type string, modifiers array<string>, is_constructor boolean, is_test boolean",
    "symbol": "id string, kind string, name string, fqname string, file_id string, line bigint, col bigint, embedding array<float>",
    "community": "id string, label string, cohesion double",
    "flow": "id string, entry_symbol_id string, kind string",
    "calls": "src_id string, dst_id string, confidence double, reason string",
    "implements": "src_id string, dst_id string, confidence double",
    "overrides": "src_id string, dst_id string, confidence double",
    "references_type": "src_id string, dst_id string, confidence double",
    "in_community": "src_id string, dst_id string",
    "in_flow": "src_id string, dst_id string, depth bigint",
    "co_changed_with": "src_id string, dst_id string, strength double, cochanges bigint, months bigint",
    "file_state": "file_id string, mtime timestamp, size bigint, cached_hash string",
    "embedding_cache": "key string, embedding array<float>",
    "site": "call_id string, source_id string, name string, receiver string, arg_count int, class_id string, class_fqcn string, package string, imports array<string>, local_types map<string,string>, field_types map<string,string>, file_id string",
    "type_ref": "class_id string, relation string, type string, imports array<string>, package string, file_id string",
}
NODES = ("project", "file", "class", "method", "symbol", "community", "flow")
CACHES = ("schema_meta", "file_state", "embedding_cache", "site", "type_ref")
EDGES = tuple(t for t in DDL if t not in NODES and t not in CACHES)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], DDL[table])


def conform(df: DataFrame, table: str, defaults: dict | None = None) -> DataFrame:
    """A table brought to its schema: missing columns get a default or null, others go."""
    defaults = defaults or {}
    out = []
    for part in _columns(DDL[table]):
        name, kind = part.split(" ", 1)
        value = F.col(name) if name in df.columns else F.lit(defaults.get(name))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def _columns(ddl: str) -> list[str]:
    return [p.strip() for p in ddl.split(", ")]
