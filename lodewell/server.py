"""Tools over an index, called by line-delimited JSON-RPC on standard input and output."""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

from . import formatting
from .sources.index import Index

VERSION = "0.1.0"
_TEXT, _WHOLE, _NUMBER = {"type": "string"}, {"type": "integer"}, {"type": "number"}
TOOLS = [
    {"name": "index_workspace", "description": "Bring the index up to date.", "inputSchema": {"type": "object", "properties": {"path": _TEXT}}},
    {"name": "search_code", "description": "Search chunks by meaning and words.", "inputSchema": {"type": "object", "properties": {"query": _TEXT, "top_k": _WHOLE, "crate_filter": _TEXT, "mmr_lambda": _NUMBER, "bm25_weight": _NUMBER}, "required": ["query"]}},
    {"name": "note_to_self", "description": "Keep a note.", "inputSchema": {"type": "object", "properties": {"text": _TEXT, "tags": {"type": "array", "items": _TEXT}}, "required": ["text"]}},
    {"name": "check_notes", "description": "Find notes by meaning.", "inputSchema": {"type": "object", "properties": {"query": _TEXT, "top_k": _WHOLE}, "required": ["query"]}},
]


class Server:
    def __init__(self, index: Index, root: str | None = None):
        self.index, self.root = index, root

    def call(self, name: str, args: dict[str, Any]) -> str:
        need = lambda k: args[k] if isinstance(args.get(k), str) and args[k] else _fail(f"missing argument: {k}")
        if name == "index_workspace":
            stats = self.index.reindex(args.get("path") or self.root or _fail("no workspace"))
            return ", ".join(f"{k}: {v}" for k, v in stats.items())
        if name == "search_code":
            query = need("query")
            if self.index.version() is None or self.index.table("chunks").isEmpty():
                return formatting.NO_CHUNKS
            rows = self.index.search(query, _int(args.get("top_k")), args.get("crate_filter"), _float(args.get("mmr_lambda")), _float(args.get("bm25_weight")), query_prefix="")
            return formatting.tool(rows).first()[0]
        if name == "note_to_self":
            tags = [t for t in args.get("tags") or [] if isinstance(t, str)]
            return f"Note saved ({self.index.add_note(need('text'), tags)})."
        if name == "check_notes":
            if self.index.table("notes").isEmpty():
                return formatting.NO_NOTES
            return formatting.notes(self.index.find_notes(need("query"), _int(args.get("top_k")) or 5)).first()[0]
        return _fail(f"unknown tool: {name}")

    def handle(self, message: dict[str, Any]) -> dict[str, Any] | None:
        """The reply to a message, None if it has none."""
        method, at = message.get("method"), message.get("id")
        if method == "notifications/initialized" or (at is None and method not in ("initialize", "tools/list", "tools/call")):
            return None
        out: dict[str, Any] = {"jsonrpc": "2.0", "id": at}
        if method == "initialize":
            return out | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "lodewell", "version": VERSION}}}
        if method == "tools/list":
            return out | {"result": {"tools": TOOLS}}
        if method == "tools/call":
            params = message.get("params") or {}
            try:
                text, failed = self.call(params.get("name", ""), params.get("arguments") or {}), False
            except Exception as e:  # a tool's failure is its result
                text, failed = str(e), True
            return out | {"result": {"content": [{"type": "text", "text": text}]} | ({"isError": True} if failed else {})}
        return out | {"error": {"code": -32601, "message": f"method not found: {method}"}}

    def serve(self, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
        """Blank lines and what isn't JSON are passed over."""
        for line in lines:
            try:
                message = json.loads(line) if line.strip() else None
            except ValueError:
                continue
            if isinstance(message, dict) and (reply := self.handle(message)) is not None:
                print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)


def _fail(why: str) -> Any:
    raise ValueError(why)


def _int(v: Any) -> int | None:
    return int(v) if isinstance(v, int | float) and not isinstance(v, bool) and v >= 0 else None


def _float(v: Any) -> float | None:
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None
