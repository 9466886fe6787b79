"""Languages by file suffix: which importer and which chunker a file gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P

# Suffix, language, importer, chunker. Suffixes are case-sensitive.
LANGUAGES = [
    (".py", "python", "python", "python"),
    (".js", "javascript", "javascript", "braces_js"),
    (".jsx", "javascript", "javascript", "braces_js"),
    (".ts", "typescript", "javascript", "braces_js"),
    (".tsx", "typescript", "javascript", "braces_js"),
    (".mjs", "javascript", "javascript", "braces_js"),
    (".go", "go", "go", "braces_go"),
    (".java", "java", "jvm", "defs_java"),
    (".kt", "kotlin", "jvm", "defs_kotlin"),
    (".scala", "scala", "jvm", "defs_scala"),
    (".cs", "csharp", "csharp", "defs_csharp"),
    (".dart", "dart", "dart", "whole"),
    (".hs", "haskell", "haskell", "defs_haskell"),
    (".lhs", "haskell", "haskell", "whole"),
    (".ex", "elixir", "elixir", "defs_elixir"),
    (".exs", "elixir", "elixir", "defs_elixir"),
    (".lua", "lua", "lua", "defs_lua"),
    (".sh", "shell", "shell", "defs_shell"),
    (".bash", "shell", "shell", "defs_shell"),
    (".r", "r", "r", "whole"),
    (".R", "r", "r", "whole"),
    (".rb", "ruby", "ruby", "defs_ruby"),
    (".rs", "rust", "rust", "defs_rust"),
    (".php", "php", "php", "defs_php"),
    (".c", "c", "c", "defs_c"),
    (".h", "c", "c", "defs_c"),
    (".cpp", "cpp", "c", "defs_cpp"),
    (".cc", "cpp", "c", "defs_cpp"),
    (".cxx", "cpp", "c", "defs_cpp"),
    (".hpp", "cpp", "c", "defs_cpp"),
    (".hh", "cpp", "c", "defs_cpp"),
    (".md", "markdown", "none", "whole"),
    (".json", "json", "none", "whole"),
    (".yaml", "yaml", "none", "whole"),
    (".yml", "yaml", "none", "whole"),
    (".toml", "toml", "none", "whole"),
    (".sql", "sql", "none", "whole"),
    (".proto", "proto", "none", "whole"),
    (".graphql", "graphql", "none", "whole"),
    (".gql", "graphql", "none", "whole"),
]

_registered: dict[str, tuple[str, str, str, str]] = {row[0]: row for row in LANGUAGES}


def register_language(suffix: str, language: str, importer: str = "none", chunker: str = "whole") -> None:
    """Adds or replaces the entry of a suffix for tables made from now on."""
    _registered[suffix] = (suffix, language, importer, chunker)


def languages(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType(), False) for n in ("suffix", "language", "importer", "chunker")])
    return spark.createDataFrame(list(_registered.values()), schema)


def suffixes() -> list[str]:
    return list(_registered)


def is_supported(suffix: str) -> bool:
    return suffix in _registered


def supported(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Files of a known suffix with their language; the table of languages is a bounded literal."""
    rows = files if "suffix" in files.columns else files.withColumn("suffix", P.suffix(F.col(path)))
    return rows.join(F.broadcast(languages(files.sparkSession)), "suffix")
