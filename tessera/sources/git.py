"""Version control on the driver: heads, logs, differences and snapshots, all with a time limit."""

from __future__ import annotations

import subprocess
import tempfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TIMEOUT_S = 5
MARK = "commit "


def _git(folder: str, *args: str, timeout: float = TIMEOUT_S) -> str | None:
    try:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def head(folder: str) -> str | None:
    out = _git(folder, "rev-parse", "HEAD")
    return out.strip() if out else None


def root(folder: str) -> str | None:
    out = _git(folder, "rev-parse", "--show-toplevel")
    return out.strip() if out else None


def log_lines(spark: SparkSession, folder: str, months: int = 6) -> DataFrame:
    """log, line_no, line: changed files of the last months' commits, a marker line before each commit's."""
    text = _git(folder, "log", f"--since={months}.months", "--name-only", f"--pretty=format:{MARK}%H", timeout=60) or ""
    rows = [(folder, i, line) for i, line in enumerate(text.splitlines())]
    return spark.createDataFrame(rows, "log string, line_no long, line string")


def recent_commits(folder: str, limit: int = 20, path: str | None = None) -> list[dict]:
    out = _git(folder, "log", f"-{limit}", "--pretty=format:%H%x1f%an%x1f%ad%x1f%s", "--date=short", *(["--", path] if path else [])) or ""
    return [dict(zip(("hash", "author", "date", "subject"), line.split("\x1f"), strict=False)) for line in out.splitlines()]


def diff_text(folder: str, ref: str = "HEAD", most_lines: int = 200) -> dict:
    lines = (_git(folder, "diff", ref, timeout=30) or "").splitlines()
    return {"diff": "\n".join(lines[:most_lines]), "truncated": len(lines) > most_lines}


@contextmanager
def snapshot(folder: str, ref: str, shared: str | None = None):
    """A folder with the tree of a ref, removed afterwards; below ``shared`` if that is a mounted folder, so that executors can read it."""
    within = shared.removeprefix("file://") if shared and (shared.startswith("/") or shared.startswith("file://")) else None
    if within:
        Path(within).mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=within, prefix="tree-") as base:
        tree = str(Path(base) / "tree")
        if _git(folder, "worktree", "add", "--detach", tree, ref, timeout=60) is None:
            raise ValueError(f"no such ref: {ref}")
        try:
            yield tree
        finally:
            _git(folder, "worktree", "remove", "--force", tree, timeout=60)
