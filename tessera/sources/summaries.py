"""Stored summaries: a JSON document in two shapes, and its table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "kind string, path string, summary string"


def read(path: str) -> tuple[str | None, dict[str, str], dict[str, str]]:
    """(commit, files, directories) of a nested document, a flat map of files, or a list of two maps."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if isinstance(found, list):
        return None, dict(found[0]), dict(found[1]) if len(found) > 1 else {}
    if "files" in found and isinstance(found["files"], dict):
        return found.get("repo_head_sha"), dict(found["files"]), dict(found.get("directories") or {})
    return found.get("repo_head_sha"), {k: v for k, v in found.items() if k != "repo_head_sha"}, {}


def write(path: str, commit: str | None, files: dict[str, str], directories: dict[str, str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"repo_head_sha": commit, "files": files, "directories": directories}, f, indent=2, ensure_ascii=False)


def table(spark: SparkSession, files: dict[str, str], directories: dict[str, str]) -> DataFrame:
    rows = [("file", k, v) for k, v in files.items()] + [("directory", k, v) for k, v in directories.items()]
    return spark.createDataFrame(rows, SCHEMA)
