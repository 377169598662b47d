"""Command line over an index: python -m tessera.cli --index DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from tessera.plans.engine import Engine
from tessera.session import local_session
from tessera.sources import git, overlay
from tessera.streaming import watch

ROWS = 200


def _show(found) -> None:
    """Tables as JSON lines, ROWS at most; other results as one JSON document."""
    if isinstance(found, DataFrame):
        for row in found.limit(ROWS).toJSON().collect():
            print(row)
    else:
        print(json.dumps(found, default=str))


COMMANDS = {
    "analyse": (["root"], lambda e, a: e.analyse(a.root, full=a.full, embed=a.embed)),
    "search": (["query"], lambda e, a: e.search(a.query, a.limit, a.project)),
    "context": (["query"], lambda e, a: {k: [r.asDict(True) for r in df.limit(ROWS).collect()] for k, df in e.context(a.query).items()}),
    "impact": (["query"], lambda e, a: e.impact(a.query, a.depth, a.project)),
    "find": (["query"], lambda e, a: e.find_symbol(a.query, a.limit)),
    "neighbourhood": (["id"], lambda e, a: e.neighbourhood(a.id)),
    "deadcode": ([], lambda e, a: e.dead_code(a.limit, a.project, a.strict)),
    "flow": ([], lambda e, a: e.flows(None, a.depth)),
    "community": (["query"], lambda e, a: e.community_of(a.query)),
    "coupling": ([], lambda e, a: e.change_coupling()),
    "diff": (["root", "base", "head"], lambda e, a: [r.asDict() for r in e.compare_refs(a.root, a.base, a.head)]),
    "git-log": (["root"], lambda e, a: git.recent_commits(a.root, a.limit)),
    "git-diff": (["root"], lambda e, a: git.diff_text(a.root)),
    "stats": ([], lambda e, a: e.stats()),
    "list": ([], lambda e, a: e.projects()),
    "packages": ([], lambda e, a: e.packages(a.limit)),
    "capabilities": ([], lambda e, a: e.capabilities()),
    "status": ([], lambda e, a: e.status()),
    "overlay-status": (["overlay"], lambda e, a: e.overlay_status(overlay.read_documents(e.spark, a.overlay))),
    "overlay-clear": (["overlay"], lambda e, a: e.clear_overlay(a.overlay, a.project)),
    "overlay-promote": (["root", "overlay"], lambda e, a: e.promote(a.root, a.overlay)),
    "overlay-update": (["overlay", "path"], lambda e, a: e.edited(a.overlay, [a.path])),
    "reindex-file": (["path"], lambda e, a: e.reindex_file(a.path)),
    "watch": (["changes", "overlay", "checkpoint"], lambda e, a: watch.follow(e, a.changes, a.overlay, a.checkpoint, once=a.full)),
    "poll-heads": (["overlay"], lambda e, a: e.poll_heads(a.overlay)),
    "match": (["text"], lambda e, a: e.match(a.text)),
    "sql": (["text"], lambda e, a: e.sql(a.text)),
    "clear-project": (["project_id"], lambda e, a: e.store.clear_project(a.project_id)),
    "clear-analysis": ([], lambda e, a: e.store.clear_analysis()),
    "clear-index": ([], lambda e, a: e.store.reset()),
}


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("--index", default="./tessera-index")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (arguments, _) in COMMANDS.items():
        one = commands.add_parser(name)
        for argument in arguments:
            one.add_argument(argument)
        one.add_argument("--limit", type=int, default=20)
        one.add_argument("--depth", type=int, default=4)
        one.add_argument("--project")
        for flag in ("--full", "--embed", "--strict"):
            one.add_argument(flag, action="store_true")
    a = parser.parse_args(argv)
    _show(COMMANDS[a.command][1](engine or Engine(local_session(), a.index), a))
    return 0


if __name__ == "__main__":
    sys.exit(main())
