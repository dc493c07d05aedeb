"""The five tools as a Model Context Protocol server over standard input and output.

One JSON-RPC message a line. A missing argument is a protocol error; a tool that fails answers
with an error content, so that the caller sees why.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

from . import __version__

PROTOCOL = "2024-11-05"
_TEXT, _COUNT, _TEXTS = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "array", "items": {"type": "string"}}
_STATE = {"type": "string", "enum": ["open", "closed", "all"]}

#: Each tool's description, arguments and which of them are needed.
TOOLS = {
    "search_issues": ("Hybrid search over issues and pull requests.", {"query": _TEXT, "repos": _TEXTS, "state": _STATE, "labels": _TEXTS, "top_k": _COUNT}, ["query"]),
    "get_issue_context": ("One issue with its comments, related issues and mentions.", {"repo": _TEXT, "number": {"type": "integer"}}, ["repo", "number"]),
    "find_related": ("The issues nearest to a known one.", {"repo": _TEXT, "number": {"type": "integer"}, "top_k": _COUNT}, ["repo", "number"]),
    "list_repos": ("Indexed repositories with their labels.", {}, []),
    "check_duplicate": ("Likely duplicates of a draft.", {"title": _TEXT, "body": _TEXT, "repos": _TEXTS, "top_k": _COUNT}, ["title", "body"]),
}
PARSE_ERROR, NO_METHOD, BAD_PARAMS = -32700, -32601, -32602


def tool_list() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]


def _error(ident, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}


def call(tools, ident, params: dict) -> dict:
    """A tool's answer; arguments that the tool doesn't have are left out."""
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        return _error(ident, BAD_PARAMS, f"no tool {name}")
    _, known, needed = TOOLS[name]
    if lacking := [a for a in needed if args.get(a) is None]:
        return _error(ident, BAD_PARAMS, f"{name} needs {', '.join(lacking)}")
    try:
        made = getattr(tools, name)(**{k: v for k, v in args.items() if k in known and v is not None})
        text, failed = json.dumps(made, ensure_ascii=False, default=str), False
    except Exception as e:
        text, failed = str(e), True
    return {"jsonrpc": "2.0", "id": ident, "result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def answer(tools, line: str) -> dict | None:
    """The reply to one message; notifications have none."""
    try:
        message = json.loads(line)
    except ValueError:
        return _error(None, PARSE_ERROR, "not JSON")
    ident, method = message.get("id"), message.get("method")
    if ident is None:
        return None
    if method == "initialize":
        return {"jsonrpc": "2.0", "id": ident, "result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tessella", "version": __version__}}}
    if method == "ping":
        return {"jsonrpc": "2.0", "id": ident, "result": {}}
    if method == "tools/list":
        return {"jsonrpc": "2.0", "id": ident, "result": {"tools": tool_list()}}
    if method == "tools/call":
        return call(tools, ident, message.get("params") or {})
    return _error(ident, NO_METHOD, f"no method {method}")


def serve(tools, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if line.strip() and (reply := answer(tools, line)) is not None:
            yield json.dumps(reply, ensure_ascii=False)


def main() -> None:
    from .cli import _tools
    from .config import Config
    from .session import session
    from .sources.store import IndexStore

    config, spark = Config(), session()
    for reply in serve(_tools(config, spark, IndexStore(spark, str(config.home))), sys.stdin):
        print(reply, flush=True)


if __name__ == "__main__":
    main()
