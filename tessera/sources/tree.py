"""A data source for source trees: every file, hidden and empty ones too.

Spark's own file sources leave out names that begin with ``_`` or ``.`` and empty files, which
a repository needs. The driver lists paths (ignored folders are pruned, not walked), executors
read the contents; a partition holds files of about ``partition_bytes``. Executors must see the
tree, as with any local path. What a query doesn't need isn't read: ``suffixes`` and ``only`` (JSON lists) choose
files by suffix or path before any is opened, and with ``content`` off none is.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

from ..functions import paths as P
from ..functions import text as T

# Folders that are never part of a repository.
IGNORED = (".git", ".venv", "venv", "__pycache__", "node_modules", ".mypy_cache", ".pytest_cache")

SCHEMA = "rel_path string, n_bytes long, content binary"


def walk(root: str, ignored: tuple[str, ...] = IGNORED) -> Iterator[tuple[str, int]]:
    """(relative path, size) of regular files; folder links aren't followed."""
    stack = [""]
    while stack:
        folder = stack.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for entry in entries:
                rel = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in ignored:
                        stack.append(rel)
                elif entry.is_file():
                    yield rel, entry.stat().st_size


def named(root: str, paths: Sequence[str], ignored: tuple[str, ...] = IGNORED) -> Iterator[tuple[str, int]]:
    """The same of these paths, without a walk; those that aren't files of the tree are left out."""
    for rel in dict.fromkeys(paths):
        parts, full = rel.split("/"), os.path.join(root, rel)
        if not rel.startswith("/") and not {"", ".", ".."} & set(parts) and not set(ignored) & set(parts[:-1]) and os.path.isfile(full):
            yield rel, os.stat(full).st_size


def suffix(path: str) -> str:
    """As ``paths.suffix`` has it: of the last part, with its dot; none of a name that only begins with a dot."""
    name = path.rpartition("/")[2]
    at = name.rfind(".")
    return name[at:] if 0 < at < len(name) - 1 else ""


@dataclass
class Files(InputPartition):
    root: str
    files: list[tuple[str, int]]
    content: bool = True


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.most = int(options.get("partition_bytes", 32 << 20))
        self.ignored = tuple(x for x in options.get("ignored", ",".join(IGNORED)).split(",") if x)
        self.only, self.suffixes = (json.loads(options.get(name, "null")) for name in ("only", "suffixes"))
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        found = walk(self.root, self.ignored) if self.only is None else named(self.root, self.only, self.ignored)
        if self.suffixes is not None:
            wanted = set(self.suffixes)
            found = (x for x in found if suffix(x[0]) in wanted)
        out, part, size = [], [], 0
        for rel, n in sorted(found, key=lambda x: x[0].split("/")):
            part.append((rel, n))
            size += n * self.content + 256
            if size >= self.most or len(part) >= 10_000:
                out.append(Files(self.root, part, self.content))
                part, size = [], 0
        return [*out, Files(self.root, part, self.content)] if part or not out else out

    def read(self, partition: Files) -> Iterator[tuple[str, int, bytes | None]]:
        for rel, n in partition.files:
            if not partition.content:
                yield rel, n, None
                continue
            with open(os.path.join(partition.root, rel), "rb") as f:
                yield rel, n, f.read()


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SourceTreeReader(dict(self.options))


def _read(spark: SparkSession, root: str, **options: object) -> DataFrame:
    spark.dataSource.register(SourceTree)
    chosen = {k: json.dumps(v) for k, v in options.items() if v is not None}
    return spark.read.format("source_tree").options(**chosen).load(root)


def source_files(spark: SparkSession, root: str, *, only: Sequence[str] | None = None, suffixes: Sequence[str] | None = None) -> DataFrame:
    """rel_path, parts, name, suffix, parent, n_bytes, content, text (null if not UTF-8), is_utf8 of every file,
    or of those with a path of ``only`` or one of ``suffixes``; no other file is opened."""
    raw = _read(spark, root, only=None if only is None else list(only), suffixes=None if suffixes is None else list(suffixes))
    path = F.col("rel_path")
    text = T.strict_text(F.col("content"))
    return raw.select("rel_path", P.parts(path).alias("parts"), P.name(path).alias("name"), P.suffix(path).alias("suffix"), P.parent(path).alias("parent"), "n_bytes", "content", text.alias("text"), text.isNotNull().alias("is_utf8"))


def source_paths(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, n_bytes) of every file; none is opened."""
    return _read(spark, root, content=False).select("rel_path", "n_bytes")


@F.pandas_udf(StringType())
def _without_broken(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: b.decode("utf-8", "ignore") if b is not None else None)


def lenient_text(content: Column | str) -> Column:
    """Bytes as text with what isn't UTF-8 left out; only bytes that hold such go through Python."""
    content = F.col(content) if isinstance(content, str) else content
    text = T.strict_text(content)
    return F.coalesce(text, _without_broken(F.when(text.isNull(), content)))
