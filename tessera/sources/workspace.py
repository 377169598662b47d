"""Projects and modules of a workspace."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files that mark a project.
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")
MODULE = "<module>\\s*([^<]+?)\\s*</module>"


def _is_project(folder: Path) -> bool:
    return any((folder / n).exists() for n in (".git", *BUILD_FILES))


def projects_in(root: str) -> list[str]:
    """The root if it is a project, else its direct subfolders that are, sorted; else the root."""
    base = Path(root)
    if _is_project(base):
        return [str(base)]
    found = sorted(str(p) for p in base.iterdir() if p.is_dir() and _is_project(p))
    return found or [str(base)]


def modules_in(project: str) -> list[str]:
    """Modules that the build file names and that exist, else subfolders with a build file, else the project."""
    base = Path(project)
    pom = base / "pom.xml"
    if pom.exists():
        named = [base / m for m in re.findall(MODULE, pom.read_text(errors="ignore")) if (base / m).is_dir()]
        if named:
            return [str(m) for m in named]
    inner = sorted(str(p) for p in base.iterdir() if p.is_dir() and any((p / n).exists() for n in BUILD_FILES))
    return inner or [str(base)]


def project_ids(root: str) -> list[tuple[str, str]]:
    """(path, id) of every module: the project's name, followed by the module's where there are several."""
    out = []
    for project in projects_in(root):
        modules = modules_in(project)
        for m in modules:
            name = Path(project).name
            out.append((m, name if modules == [project] else f"{name}::{Path(m).name}"))
    return out


def module_names(build_files: DataFrame, content: Column) -> DataFrame:
    """Rows with each module name that a build file's text lists, in order of appearance."""
    return build_files.select("*", F.explode(F.regexp_extract_all(content, F.lit(MODULE), F.lit(1))).alias("module"))


def to_modules(files: DataFrame, modules: DataFrame, path: str = "path") -> DataFrame:
    """Files with the module whose folder is their longest prefix.

    modules: module_path, project_id. Every folder above a file is tried with an equi-join, so there
    is no join on prefixes.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = files.select(path, F.explode(above).alias("module_path")).join(modules, "module_path")
    best = tried.groupBy(path).agg(F.max_by("project_id", F.length("module_path")).alias("project_id"))
    return files.drop("project_id").join(best, path, "left")
