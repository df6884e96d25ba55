"""Command line: serve, reindex, query, hook, add-repo, remove-repo, repos, gc."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from . import formatting
from .config import Settings, expand_home, portable
from .server import Server
from .sources.index import Index, search_workspaces
from .sources.registry import Registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodewell")
    p.add_argument("--config", default=os.path.expanduser("~/.config/lodewell/config.toml"))
    p.add_argument("--index", help="folder of the index; by default .lodewell in the workspace")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("serve")
    sub.add_parser("reindex")
    q = sub.add_parser("query")
    q.add_argument("prompt", nargs="?")
    q.add_argument("--json", action="store_true", help="read a JSON object from standard input and take its prompt")
    h = sub.add_parser("hook")
    h.add_argument("--format", choices=sorted(formatting.FORMATS), default="grouped")
    for name in ("add-repo", "remove-repo"):
        sub.add_parser(name).add_argument("path")
    sub.add_parser("repos")
    sub.add_parser("gc").add_argument("--days", type=int, default=30)
    return p


def prompt(args: argparse.Namespace, stdin=sys.stdin) -> str:
    if getattr(args, "prompt", None):
        return args.prompt
    text = stdin.read()
    if getattr(args, "json", False) or args.command == "hook":
        given = json.loads(text).get("prompt")
        if given is None:
            raise SystemExit("the input has no prompt")
        return given
    return text.strip()


def repos(settings: Settings, command: str, path: str, home: str) -> str:
    """Adds or removes a workspace in the settings; says what was done."""
    own = portable(os.path.abspath(expand_home(path, home)), home)
    if command == "add-repo":
        if own in settings.index.workspaces:
            return f"{own} is there already"
        settings.index.workspaces.append(own)
        return f"added {own}"
    if own not in settings.index.workspaces:
        return f"{own} is not there"
    settings.index.workspaces.remove(own)
    return f"removed {own}"


def main(argv: list[str] | None = None) -> None:
    args, home = parser().parse_args(argv), os.path.expanduser("~")
    settings = Settings.load(args.config)
    if args.command in ("add-repo", "remove-repo"):
        print(repos(settings, args.command, args.path, home))
        os.makedirs(os.path.dirname(args.config), exist_ok=True)
        settings.save(args.config)
        return
    if args.command == "repos":
        print("\n".join(settings.index.workspaces))
        return
    spark = SparkSession.builder.appName("lodewell").getOrCreate()
    roots = [expand_home(w, home) for w in settings.index.workspaces] or [os.getcwd()]
    indexes = {root: Index(spark, args.index or Registry().add(root), settings=settings) for root in roots}
    if args.command == "serve":
        return Server(indexes[roots[0]], roots[0]).serve()
    if args.command in ("query", "hook"):
        there = {root: index for root, index in indexes.items() if index.version() is not None}
        text, shown = prompt(args), ""
        if text and there:
            shown = formatting.FORMATS[getattr(args, "format", "grouped")](search_workspaces(there, text)).first()[0]
        print(formatting.hook_response("UserPromptSubmit", shown) if args.command == "hook" else shown)
        return
    if args.command == "gc":
        print(f"{Registry().gc()} entries of workspaces that are gone")
    for root, index in indexes.items():
        print(root, index.reindex(root) if args.command == "reindex" else f"{index.gc_cache(args.days)} cached vectors dropped")


if __name__ == "__main__":
    main()
