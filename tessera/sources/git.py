"""Data sources for commit logs and commit differences, read by the git command line."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def run(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed in {repo}: {done.stderr.strip()}")
    return done.stdout


def head(repo: str) -> str | None:
    """The commit checked out; None outside a repository."""
    try:
        return run(repo, "rev-parse", "HEAD").strip()
    except RuntimeError:
        return None


def clone(url: str, target: str) -> str:
    done = subprocess.run(["git", "clone", "--depth", "1", url, target], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"cannot clone {url}: {done.stderr.strip()}")
    return target


@dataclass
class Paths(InputPartition):
    paths: list[str]


class GitLogReader(DataSourceReader):
    """One commit list for each file, newest first; files without history give no rows."""

    def __init__(self, options: dict[str, str]):
        self.repo, self.n = options["path"], int(options.get("n", 10))
        self.files = [x for x in options.get("files", "").split("\n") if x]

    def partitions(self) -> list[InputPartition]:
        return [Paths(self.files[k : k + 50]) for k in range(0, len(self.files), 50)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple[str, int, str, str]]:
        for path in partition.paths:
            try:
                lines = run(self.repo, "log", "--oneline", "-n", str(self.n), "--", path).splitlines()
            except RuntimeError:
                continue
            for k, line in enumerate(lines):
                sha, _, message = line.partition(" ")
                yield path, k, sha, message


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "file_path string, ord int, sha string, message string"

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(dict(self.options))


class GitDiffReader(DataSourceReader):
    """(path, status) between a saved commit and HEAD; a rename is its deletion and its addition."""

    def __init__(self, options: dict[str, str]):
        self.repo, self.since = options["path"], options["since"]

    def partitions(self) -> list[InputPartition]:
        return [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple[str, str]]:
        for line in run(self.repo, "diff", "--no-renames", "--name-status", f"{self.since}..HEAD").splitlines():
            status, _, path = line.partition("\t")
            yield path, {"T": "M"}.get(status[:1], status[:1])


class GitDiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return "path string, status string"

    def reader(self, schema) -> DataSourceReader:
        return GitDiffReader(dict(self.options))


def commits(spark: SparkSession, repo: str, files: list[str], n: int = 10) -> DataFrame:
    """file_path, ord, sha, message: the last n commits of each of a few files."""
    spark.dataSource.register(GitLog)
    return spark.read.format("git_log").option("files", "\n".join(files)).option("n", n).load(repo)


def changed_paths(spark: SparkSession, repo: str, since: str) -> DataFrame:
    """path, status (A, C, M or D) since a commit."""
    spark.dataSource.register(GitDiff)
    return spark.read.format("git_diff").option("since", since).load(repo)
