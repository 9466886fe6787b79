"""What the jobs share: settings, their command line, and reading a table that may not be there yet."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def settings(defaults: dict, path: str | None) -> dict:
    """The defaults, overridden by the settings file; a name that no job knows is an error."""
    found = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    if unknown := sorted(set(found) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | found


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table below ``path``; empty if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command(run: Callable[..., dict], *paths: str, argv: list[str] | None = None) -> int:
    """Runs a job with the paths of the command line in a session of its own."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    for name in paths:
        parser.add_argument(name, help=f"path of {name.replace('_', ' ')}")
    parser.add_argument("--config", help="settings file (TOML)")
    parser.add_argument("--checkpoints", help="shared folder for intermediate tables (spark.checkpoint.dir)")
    found = vars(parser.parse_args(argv))
    config, shared = found.pop("config"), found.pop("checkpoints")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    builder = SparkSession.builder.appName(run.__module__)
    spark = (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()
    try:
        run(spark, **found, config=config)
    finally:
        spark.stop()
    return 0
