"""Chunks of source files: definitions where a parser or patterns know them, else the whole file."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .definitions import definitions
from .lineage import bound_batches
from .python_source import CHUNKS, chunk_column

#: Chunkers that begin so name a language of ``definitions``.
DEFINITIONS = "defs_"

# Lines that begin a chunk.
HEADERS = {
    "braces_js": r"""
        ^[ \t]*
        (?:export\s+(?:default\s+)?)?
        (?:
            (?:async\s+)?function\s*\*?\s*\w+
            |class\s+\w+
            |(?:const|let|var)\s+\w+\s*=\s*
              (?:async\s+)?\(.*?\)\s*=>
            |(?:const|let|var)\s+\w+\s*=\s*
              (?:async\s+)?function
        )
        """,
    "braces_go": r"^func(?:\s*\([^)]+\))?\s+\w+\s*(?:\[.*?\])?\s*\(",
}


def header(kind: str) -> re.Pattern:
    return re.compile(HEADERS[kind], re.VERBOSE if kind == "braces_js" else 0)


def braced(source: str, begins: re.Pattern) -> list[tuple[int, int, str]]:
    """From each header line to the line where its braces close; chunks don't overlap.

    One that never closes reaches one line past the end; a file without headers is one chunk. The
    depth after every line is known first, so a chunk's end is looked up: the first line from the next
    opening brace on that is as deep as the line before the header.
    """
    lines = source.splitlines()
    after = list(accumulate((x.count("{") - x.count("}") for x in lines), initial=0))  # after[n]: the depth after n lines
    opening = [k for k, x in enumerate(lines) if "{" in x]
    ends: dict[int, list[int]] = {}
    for k in range(len(lines)):
        ends.setdefault(after[k + 1], []).append(k)
    found, free = [], 0
    for start in (k for k, x in enumerate(lines) if begins.match(x)):
        if start < free:
            continue
        first = bisect_left(opening, start)
        closing = ends.get(after[start], []) if first < len(opening) else []
        at = bisect_left(closing, opening[first]) if closing else 0
        free = closing[at] + 1 if at < len(closing) else len(lines) + 1
        found.append((start + 1, free, "\n".join(lines[start:free])))
    return found or [(1, len(lines), source)]


def _braces_column(kind: str):
    begins = header(kind)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([[{"start_line": a, "end_line": b, "text": t} for a, b, t in braced(x, begins)] if x is not None else [] for x in part])

    return F.pandas_udf(run, CHUNKS)


def _definitions_column():
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, texts in parts:
            yield pd.Series([[{"start_line": a, "end_line": b, "text": t} for a, b, t in definitions(kind.removeprefix(DEFINITIONS), x)] for kind, x in zip(kinds, texts, strict=True)], dtype=object)

    return F.pandas_udf(run, CHUNKS)


def chunks(files: DataFrame) -> DataFrame:
    """(rel_path, chunk_no, start_line, end_line, text) of files (rel_path, chunker, text); 1-based, inclusive.

    Only the files that need a parser or patterns go through Python; whole-file chunks stay in the JVM. A file
    that isn't UTF-8 has none.
    """
    bound_batches(files.sparkSession)
    readable = files.filter(F.col("text").isNotNull())
    whole = readable.filter("chunker = 'whole'").select("rel_path", F.lit(0).alias("chunk_no"), F.lit(1).alias("start_line"), T.line_count(F.col("text")).alias("end_line"), "text")
    parsed = [readable.filter("chunker = 'python'").select("rel_path", F.posexplode(chunk_column("text")).alias("chunk_no", "c"))]
    parsed += [readable.filter(F.col("chunker") == kind).select("rel_path", F.posexplode(_braces_column(kind)("text")).alias("chunk_no", "c")) for kind in HEADERS]
    parsed.append(readable.filter(F.col("chunker").startswith(DEFINITIONS)).select("rel_path", F.posexplode(_definitions_column()("chunker", "text")).alias("chunk_no", "c")))
    for rows in parsed:
        whole = whole.unionByName(rows.select("rel_path", "chunk_no", "c.start_line", "c.end_line", "c.text"))
    return whole


def non_blank(rows: DataFrame) -> DataFrame:
    return rows.filter(~T.is_blank(F.col("text")))
