"""JSON-RPC 2.0 over lines: the tools of `tools.Tools` for clients that speak initialize, tools/list and tools/call."""

from __future__ import annotations

import inspect
import json
import sys
from typing import IO

from corvane.plans.tools import ToolError, Tools
from pyspark.sql import DataFrame

#: Error codes of the protocol.
PARSE, METHOD, PARAMS = -32700, -32601, -32602
ROWS = 500


def compact(df: DataFrame, most: int = ROWS) -> dict:
    """{columns, rows, total}: at most `most` rows, and the number of all of them where that is larger."""
    rows = df.limit(most + 1).collect()
    total = len(rows) if len(rows) <= most else df.count()
    return {"columns": df.columns, "rows": [list(json.loads(json.dumps(list(r), default=str))) for r in rows[:most]], "total": total}


def reply(tools: Tools, line: str) -> dict | None:
    """The response to one message, or None to a notification."""
    try:
        message = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "parse error"}}
    if not isinstance(message, dict) or "id" not in message:
        return None
    out, params = {"jsonrpc": "2.0", "id": message["id"]}, message.get("params") or {}
    method = message.get("method")
    if method == "initialize":
        return out | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "corvane", "version": "1"}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        listed = []
        for name in tools.names():
            f = inspect.signature(getattr(tools, f"tool_{name}"))
            need = [p.name for p in f.parameters.values() if p.default is p.empty]
            listed.append({"name": name, "description": (inspect.getdoc(getattr(tools, f"tool_{name}")) or name.replace("_", " ")), "inputSchema": {"type": "object", "properties": {p: {} for p in f.parameters}, "required": need}})
        return out | {"result": {"tools": listed}}
    if method != "tools/call":
        return out | {"error": {"code": METHOD, "message": f"unknown method: {method}"}}
    if not isinstance(params.get("name"), str):
        return out | {"error": {"code": PARAMS, "message": "missing name"}}
    try:
        text, failed = json.dumps(compact(tools.call(params["name"], **(params.get("arguments") or {})))), False
    except ToolError as e:
        text, failed = str(e), True
    return out | {"result": {"content": [{"type": "text", "text": text}]} | ({"isError": True} if failed else {})}


def serve(tools: Tools, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
    for line in lines:
        if line.strip() and (answer := reply(tools, line)) is not None:
            out.write(json.dumps(answer) + "\n")
            out.flush()
