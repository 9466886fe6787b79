"""Python files read with the standard parser: definitions and imports.

The syntax tree needs Python, so these are Arrow-batched functions; what they return is resolved
and filtered by DataFrame operations.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = T.ArrayType(T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("text", T.StringType())]))
_IMPORT = T.StructType([T.StructField("module", T.StringType()), T.StructField("level", T.IntegerType())])
IMPORTS = T.StructType([T.StructField("error", T.StringType()), T.StructField("imports", T.ArrayType(_IMPORT))])


def _tree(source: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(source)


def definitions(source: str) -> list[tuple[int, int, str]]:
    """Every function and class, nested ones too, breadth first; nothing if the file doesn't parse."""
    try:
        tree = _tree(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = source.splitlines()
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    found = [n for n in ast.walk(tree) if isinstance(n, kinds)]
    return [(n.lineno, n.end_lineno, "\n".join(lines[n.lineno - 1 : n.end_lineno])) for n in found]


def imported(source: str) -> tuple[str | None, list[tuple[str, int]]]:
    """(error, [(module, level)]) in breadth-first order; only the module of a from-import counts."""
    try:
        tree = _tree(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return f"SyntaxError: {e}", []
    found: list[tuple[str, int]] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [(alias.name, 0) for alias in node.names]
        elif isinstance(node, ast.ImportFrom):
            found.append((node.module or "", node.level))
    return None, found


@F.pandas_udf(CHUNKS)
def chunk_column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([[{"start_line": a, "end_line": b, "text": t} for a, b, t in definitions(x)] if x is not None else [] for x in part])


@F.pandas_udf(IMPORTS)
def import_column(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        rows = [imported(x) if x is not None else ("not UTF-8", []) for x in part]
        yield pd.DataFrame({"error": [e for e, _ in rows], "imports": [[{"module": m, "level": n} for m, n in found] for _, found in rows]})
