"""The command line: ingest, query, init."""

from __future__ import annotations

import argparse
import json
import shlex
import sys

from pyspark.sql import SparkSession

from ..operators.generate import Process
from ..scope import Scope
from . import render
from .engine import Engine


SETUP = """Set these variables, or pass --vault and --index:
  VAULT_ROOT       folder of the notes
  INDEX_PATH       folder of the index
  REPO_ROOT        the repository
  GUIDELINES_PATH  the project's conventions (optional)
Then run: tessera ingest REPO, tessera query QUESTION, or tessera-server for the tools."""


def pairs(items: list[str]) -> dict[str, str]:
    """``key=value`` items; one without a sign is named on stderr and left out."""
    found = {}
    for item in items:
        key, sign, value = item.partition("=")
        if not sign or not key.strip():
            print(f"ignored, not key=value: {item}", file=sys.stderr)
            continue
        found[key.strip()] = value.strip()
    return found


def json_object(text: str | None) -> dict[str, object]:
    """Extra front matter given as JSON; anything but an object is an error."""
    found = json.loads(text or "{}")
    if not isinstance(found, dict):
        raise ValueError("front matter must be a JSON object")
    return found


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("repo")
    ingest.add_argument("--vault", default="vault")
    ingest.add_argument("--index", default="index")
    ingest.add_argument("--dry-run", action="store_true")
    ingest.add_argument("--reuse", action="store_true", help="take stored summaries")
    ingest.add_argument("--explanations", help="take the summaries of this JSON file")
    ingest.add_argument("--no-text", action="store_true", help="notes without generated summaries")
    ingest.add_argument("--frontmatter", nargs="*", default=[], help="key=value pairs")
    ingest.add_argument("--frontmatter-json", help="a JSON object of further front matter")
    ingest.add_argument("--command", dest="command_line", help="program that answers prompts from standard input")
    query = commands.add_parser("query")
    query.add_argument("question")
    query.add_argument("--vault", default="vault")
    query.add_argument("--index", default="index")
    query.add_argument("-n", type=int, default=5)
    commands.add_parser("init")
    own = parser.parse_args(args)
    if own.command == "init":
        print(SETUP)
        print(json.dumps({"VAULT_ROOT": "vault", "INDEX_PATH": "index", "REPO_ROOT": "."}, indent=2))
        return 0
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    command = shlex.split(getattr(own, "command_line", None) or "")
    engine = Engine(spark, Scope(own.vault, own.index, getattr(own, "repo", None)), Process(command) if command else None)
    if own.command == "query":
        found = engine.search(own.question, own.n).persist()
        print(render.hits(found.collect(), engine.snippets(found)))
    elif own.dry_run:
        print(engine.dry_run(own.repo))
    else:
        print(engine.ingest(own.repo, extra=pairs(own.frontmatter) | json_object(own.frontmatter_json), reuse=own.reuse, generate_text=not own.no_text, explanations=own.explanations))
    return 0


if __name__ == "__main__":
    sys.exit(main())
