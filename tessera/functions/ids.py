"""Deterministic SHA-1 identifiers, as expressions and as plain functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sha(*parts: Column | str) -> Column:
    return F.sha1(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def file_id(project: Column, rel_path: Column) -> Column:
    return _sha(project, ":", rel_path)


def class_id(scope: Column, fqcn: Column, project: Column | None = None) -> Column:
    """With ``project``, equal names in two projects stay apart; without it ids are as in older indexes."""
    return _sha(*([project, "|"] if project is not None else []), F.when(scope.isNull() | (scope == ""), F.lit("")).otherwise(F.concat(scope, F.lit("::"))), fqcn)


def method_id(scope: Column, fqcn: Column, signature: Column, project: Column | None = None) -> Column:
    return class_id(scope, F.concat(fqcn, F.lit("#"), signature), project)


def symbol_id(kind: Column, scope: Column, fqname: Column, project: Column | None = None) -> Column:
    return _sha(*([project, "|"] if project is not None else []), kind, ":", F.coalesce(scope, F.lit("")), ":", fqname)


def digest(content: Column) -> Column:
    """SHA-1 of raw bytes."""
    return F.sha1(content)


def sha1_text(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()


def scope(path: Column) -> Column:
    """Module part of a relative path: before '/java/', else before '/src/', else its folder, else '.'."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return (
        F.when(path.contains("/java/"), F.substring_index(path, "/java/", 1))
        .when(path.contains("/src/"), F.substring_index(path, "/src/", 1))
        .when(folder != "", folder)
        .otherwise(F.lit("."))
    )


def is_test_path(path: Column) -> Column:
    return path.contains("src/test/java")
