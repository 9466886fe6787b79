"""Text generation: a provider behind a small protocol, called in Arrow batches with retries.

The built-in provider needs no model: it extracts. Its answers are deterministic, which is what
tests and offline runs want; a real provider only has to implement ``generate``.
"""

from __future__ import annotations

import re
import shutil
import subprocess
import time
from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from . import lookups
from .lineage import checkpoint

ATTEMPTS = 3
PAUSES = (1.0, 2.0)


class TextGenerator(Protocol):
    concurrency: int

    def available(self) -> bool: ...

    def generate(self, prompts: Sequence[str]) -> list[str]: ...


class Extractive:
    """Answers from the prompt itself: the first comment or text line, and the names it defines."""

    concurrency = 8

    def available(self) -> bool:
        return True

    def generate(self, prompts: Sequence[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        task, _, body = prompt.partition("\n===\n")
        names = list(dict.fromkeys(re.findall(r"(?:def|class|function|func|struct|interface)\s+(\w+)", body)))[:8]
        first = next((x.strip(" \t#/*\"'-<!>") for x in body.splitlines() if x.strip(" \t#/*\"'-<!>")), "")[:160]
        if task.startswith("QUESTIONS"):
            topics = names or [first[:40] or "this part"]
            return "\n".join(f"What does {t} do and where is it used?" for t in topics[:3])
        if task.startswith("JUDGE"):
            old, _, new = body.partition("\n---new---\n")
            same = re.sub(r"\W+", " ", old).strip().lower() == re.sub(r"\W+", " ", new).strip().lower()
            return f"CONFLICT: {'no' if same else 'yes'}\nREASON: {'the meaning is unchanged' if same else 'the summary says something else now'}"
        return f"{first} Defines {', '.join(names)}." if names else first


class Process:
    """Answers of an external program: each prompt goes to its standard input, its standard output is the answer."""

    def __init__(self, command: Sequence[str], concurrency: int = 8, seconds: float = 300.0):
        self.command, self.concurrency, self.seconds = list(command), concurrency, seconds

    def available(self) -> bool:
        return shutil.which(self.command[0]) is not None

    def generate(self, prompts: Sequence[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        done = subprocess.run(self.command, input=prompt, capture_output=True, text=True, timeout=self.seconds, check=False)
        if done.returncode:
            raise RuntimeError(f"{self.command[0]} ended with {done.returncode}: {done.stderr.strip() or done.stdout.strip()}")
        return done.stdout.strip()


def call(generator: TextGenerator, prompts: Sequence[str], sleep=time.sleep) -> list[str]:
    """Stripped answers; up to three attempts, one and two seconds apart, then an error."""
    for attempt in range(ATTEMPTS):
        try:
            return [x.strip() for x in generator.generate(prompts)]
        except Exception as e:
            if attempt == ATTEMPTS - 1:
                raise RuntimeError(f"the generator failed {ATTEMPTS} times: {e}") from e
            sleep(PAUSES[attempt])
    raise AssertionError


class AnswerStore:
    """Answers that were given already, in Parquet: a prompt is asked once for each provider and version.

    What isn't known yet is asked in rounds of as many tasks as the provider takes calls at once, each of at most
    ``per_task`` prompts, and every round is appended before the next begins. So a run that is cut off has lost one
    round at most, a lost task asks its own prompts again, and tasks don't grow with the number of prompts. Where the
    provider fails, its task asks no further, what has been answered is kept, and the error says how much that is; the
    next run asks for the rest only.
    """

    SCHEMA = "key string, reply string"

    def __init__(self, spark: SparkSession, path: str, version: str = "1", per_task: int = 256):
        self.spark, self.path, self.version, self.per_task = spark, path.rstrip("/"), version, per_task

    def _folder(self, generator: TextGenerator) -> str:
        name = re.sub(r"[^A-Za-z0-9.-]+", "-", getattr(generator, "name", type(generator).__name__))
        return f"{self.path}/provider={name}-{self.version}"

    def known(self, generator: TextGenerator) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self._folder(generator)).dropDuplicates(["key"])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def answered(self, rows: DataFrame, prompt: Column, generator: TextGenerator, name: str) -> DataFrame:
        """``rows`` with their answers; those that aren't stored yet are asked first."""
        keyed = rows.withColumn("_key", F.sha2(prompt.cast("binary"), 256))
        missing = keyed.withColumn("_prompt", prompt).groupBy("_key").agg(F.first("_prompt").alias("_prompt")).join(self.known(generator).select(F.col("key").alias("_key")), "_key", "left_anti")
        missing = checkpoint(missing)
        at_once = max(1, generator.concurrency)
        n = missing.count()
        rounds = -(-n // (at_once * self.per_task))
        place = F.pmod(F.xxhash64("_key"), F.lit(max(1, rounds)))
        for k in range(rounds):
            asked = missing.filter(place == k).repartition(at_once, "_key")
            replied = checkpoint(asked.select(F.col("_key").alias("key"), _asked_each(generator)("_prompt").alias("r")).select("key", "r.*"))
            replied.filter("error IS NULL").select("key", "reply").write.mode("append").parquet(self._folder(generator))
            failed = replied.filter("error IS NOT NULL").agg(F.min("error")).first()[0]
            if failed:
                done = missing.join(self.known(generator), F.col("_key") == F.col("key"), "left_semi").count()
                raise RuntimeError(f"{done} of {n} new prompts are answered and kept, a rerun asks for the rest only: {failed}")
        return keyed.join(self.known(generator).select(F.col("key").alias("_key"), F.col("reply").alias(name)), "_key").drop("_key")


def _asked_each(generator: TextGenerator):
    """Answers as far as they come: after a failure a task asks no further."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        failed = None
        for part in batches:
            prompts, replies = part.tolist(), []
            try:
                replies = call(generator, prompts) if prompts and not failed else []
            except RuntimeError as e:
                failed = str(e)
                try:  # one by one up to the first that fails
                    for prompt in prompts if len(prompts) > 1 else []:
                        replies += call(generator, [prompt])
                except RuntimeError as one:
                    failed = str(one)
                else:
                    failed = None if len(replies) == len(prompts) else failed
            rest = len(prompts) - len(replies)
            yield pd.DataFrame({"reply": replies + [None] * rest, "error": [None] * len(replies) + [failed] * rest})

    return F.pandas_udf(run, "reply string, error string").asNondeterministic()


def _asked(generator: TextGenerator):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series(call(generator, part.tolist()) if len(part) else [], dtype=object)

    return F.pandas_udf(run, "string").asNondeterministic()


def answers(rows: DataFrame, prompt: Column, generator: TextGenerator, name: str = "reply", store: AnswerStore | None = None) -> DataFrame:
    """``rows`` with the generator's answers, from ``store`` as far as it knows them.

    Without a store there are as many tasks as the provider takes calls at once, and answers may differ between calls,
    so callers write the result down before using it twice.
    """
    if store is not None:
        return store.answered(rows, prompt, generator, name)
    return rows.repartition(generator.concurrency).withColumn(name, _asked(generator)(prompt))


def file_summaries(files: DataFrame, generator: TextGenerator, store: AnswerStore | None = None) -> DataFrame:
    """(path, summary) of files (rel_path, text) that aren't blank; the first 12,000 characters count."""
    readable = files.filter(F.col("text").isNotNull() & ~T.is_blank(F.col("text")))
    prompt = F.concat(F.lit("SUMMARISE the purpose of the file "), "rel_path", F.lit(" for someone new to the project.\n===\n"), T.head(F.col("text")))
    return answers(readable.select("rel_path", "text"), prompt, generator, "summary", store).select(F.col("rel_path").alias("path"), "summary")


def directory_summaries(summaries: DataFrame, generator: TextGenerator, store: AnswerStore | None = None) -> DataFrame:
    """(path, summary) of directories from the summaries of their own files; the root is left out."""
    rows = summaries.withColumn("folder", P.parent(F.col("path"))).filter("folder <> '.'")
    grouped = lookups.joined_summaries(rows, "folder", "path", "summary")
    prompt = F.concat(F.lit("SUMMARISE the directory "), "folder", F.lit(" from its files.\n===\n"), "text")
    return answers(grouped, prompt, generator, "summary", store).select(F.col("folder").alias("path"), "summary")


def chunk_questions(chunks: DataFrame, generator: TextGenerator, store: AnswerStore | None = None) -> DataFrame:
    """Chunks (rel_path, start_line, end_line, text) with one row for each question that a chunk answers."""
    prompt = F.concat(F.lit("QUESTIONS that this code answers, one a line.\n===\n"), "text")
    replied = answers(chunks.filter(~T.is_blank(F.col("text"))), prompt, generator, store=store)
    return replied.select("rel_path", "start_line", "end_line", F.explode(T.questions(F.col("reply"))).alias("question"))


def judged(rows: DataFrame, generator: TextGenerator, store: AnswerStore | None = None) -> DataFrame:
    """Rows (path, old, new) with ``conflict`` and ``reason``."""
    prompt = F.concat(F.lit("JUDGE whether the new text contradicts the old one.\n===\n"), "old", F.lit("\n---new---\n"), "new")
    replied = answers(rows, prompt, generator, store=store)
    return replied.withColumn("conflict", T.conflict(F.col("reply"))).withColumn("reason", T.reason(F.col("reply"))).drop("reply")
