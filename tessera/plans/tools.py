"""The tools by name, and a server that answers calls over standard input and output.

Each line is a JSON-RPC 2.0 request; ``tools/list`` names the tools with their parameters,
``tools/call`` runs one. Every tool takes vault_root, index_path and repo_root as overrides.
"""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import SparkSession

from ..scope import Scope
from .cli import json_object
from .engine import Engine

#: name -> (method of the engine, what it answers)
TOOLS: dict[str, tuple[Callable, str]] = {
    "search_code": (Engine.search_code, "Which code answers a question: the nearest chunks, with their notes and a confidence."),
    "explore_repo": (Engine.explore_repo, "How the repository is built: an overview of its notes, breadth first."),
    "find_todos": (Engine.find_todos, "Open tasks and recent commits of the files that a question is about."),
    "read_guidelines": (Engine.read_guidelines, "The project's conventions."),
    "vault_append": (Engine.vault_append, "Which note an annotation belongs to; nothing is written."),
    "get_active_scope": (Engine.active_scope, "Which folders the answers come from."),
    "estimate_cost": (Engine.estimate_cost, "How many generator calls an ingest would take."),
    "ingest_repo": (Engine.ingest, "Summaries, notes and index of a repository."),
    "rebuild_vault": (Engine.rebuild, "Notes and index again, from the stored summaries."),
    "sync_vault": (Engine.sync, "Brings notes and index up to the commit checked out."),
}
SCOPE = ("vault_root", "index_path", "repo_root")


class Server:
    """Tool calls on one Spark session; engines are made for each call's scope."""

    def __init__(self, spark: SparkSession, make: Callable[[SparkSession, Scope], Engine] = Engine):
        self.spark, self.make = spark, make

    def tools(self) -> list[dict]:
        out = []
        for name, (method, text) in TOOLS.items():
            own = [p for p in inspect.signature(method).parameters if p != "self"]
            out.append({"name": name, "description": text, "inputSchema": {"type": "object", "properties": {p: {} for p in [*own, *SCOPE]}}})
        return out

    def call(self, name: str, arguments: dict) -> str:
        method, _ = TOOLS[name]
        scope = Scope(**{f: arguments.pop(f, None) for f in SCOPE})
        if isinstance(arguments.get("extra"), str):
            arguments["extra"] = json_object(arguments["extra"])
        answer = method(self.make(self.spark, scope), **arguments)
        return answer if isinstance(answer, str) else json.dumps(answer)

    def answer(self, request: dict) -> dict | None:
        """The response to one request; None for a notification."""
        kind, params = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        out: dict = {"jsonrpc": "2.0", "id": request["id"]}
        try:
            if kind == "initialize":
                return out | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "0.2"}}}
            if kind == "tools/list":
                return out | {"result": {"tools": self.tools()}}
            if kind == "tools/call" and params.get("name") in TOOLS:
                return out | {"result": {"content": [{"type": "text", "text": self.call(params["name"], dict(params.get("arguments") or {}))}]}}
            return out | {"error": {"code": -32601, "message": f"unknown: {kind} {params.get('name', '')}".strip()}}
        except Exception as e:  # an error is an answer, the server goes on
            return out | {"result": {"isError": True, "content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}]}}

    def serve(self, requests: TextIO, replies: TextIO) -> None:
        for line in requests:
            if line.strip() and (reply := self.answer(json.loads(line))) is not None:
                replies.write(json.dumps(reply) + "\n")
                replies.flush()


def main() -> int:
    Server(SparkSession.builder.appName("tessera-server").getOrCreate()).serve(sys.stdin, sys.stdout)
    return 0
