"""Import edges: what each file names, and which file of the repository that is.

Extraction is a list of rules, each a Java regex with the flags that make it read like its
Python counterpart, and a function from the name to candidate paths in order of preference.
Existence is membership in the listing of the repository (files, and directories with a
slash at the end), a join; the first existing candidate wins, then the first occurrence of each
target counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .lineage import bound_batches
from .python_source import import_column

Candidates = Callable[[Column, Column, Column], list[Column] | Column]


@dataclass(frozen=True)
class Rule:
    """``label``: what an unresolved name is called in a warning; None for silence."""

    importer: str
    pattern: str
    candidates: Candidates
    label: str | None = None
    groups: int = 1
    clean: Callable[[Column], Column] = lambda raw: raw
    keep: Callable[[Column], Column] | None = None
    inside: str | None = None  # a pattern whose first group is searched instead of the whole text


def _slashed(raw: Column) -> Column:
    return F.replace(raw, F.lit("."), F.lit("/"))


def _near(raw: Column, folder: Column) -> Column:
    return P.join(folder, raw)


# Suffixes tried, in order.
_JS = (".js", ".ts", ".jsx", ".tsx", ".mjs")
_JVM = (".java", ".kt", ".scala")


def _js(raw: Column, folder: Column, suffix: Column) -> list[Column]:
    base = _near(raw, folder)
    return [base, *(P.with_suffix(base, s) for s in _JS), *(P.join(base, F.lit(f"index{s}")) for s in _JS)]


def _go(raw: Column, folder: Column, suffix: Column) -> Column:
    p = F.split(raw, "/")
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.concat(F.array_join(F.slice(p, n, F.size(p)), "/"), F.lit("/")))


def _jvm(raw: Column, folder: Column, suffix: Column) -> Column:
    order = F.concat(F.array(suffix), F.array_except(F.array(*map(F.lit, _JVM)), F.array(suffix)))
    return F.transform(order, lambda s: F.concat(_slashed(raw), s))


def _elixir(raw: Column, folder: Column, suffix: Column) -> list[Column]:
    base = F.array_join(F.transform(F.split(raw, r"\."), P.snake_case), "/")
    return [F.concat(F.lit(root), base, F.lit(s)) for root in ("", "lib/") for s in (".ex", ".exs")]


def _php(raw: Column, folder: Column, suffix: Column) -> list[Column]:
    full = F.when(P.suffix(raw) == "", F.concat(raw, F.lit(".php"))).otherwise(raw)
    return [_near(full, folder), full]


# The patterns of the names that a file imports, and what a warning calls them.
RULES = [
    Rule("javascript", r"""(?mdU)(?:import|export)\s+(?:[^'"]*?\s+from\s+)?['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\)""", _js, "import", groups=2, keep=lambda raw: raw.startswith(".")),
    Rule("go", r'(?mdU)^import\s+"([^"]+)"', _go),
    Rule("go", r'(?mdU)"([^"]+)"', _go, inside=r"(?sdU)import\s+\((.*?)\)"),
    Rule("jvm", r"(?mdU)^import\s+(?:static\s+)?([\w.]+)", _jvm, clean=lambda raw: F.regexp_replace(raw, r"[.*]+\z", "")),
    Rule("csharp", r"(?mdU)^using\s+(?:static\s+)?([\w.]+)\s*;", lambda raw, folder, suffix: [F.concat(_slashed(raw), F.lit(".cs"))]),
    Rule("dart", r"""(?mdU)^import\s+['"]([^'"]+)['"]""", lambda raw, folder, suffix: [_near(raw, folder)], "import", keep=lambda raw: ~raw.startswith("dart:") & ~raw.startswith("package:")),
    Rule("haskell", r"(?mdU)^import\s+(?:qualified\s+)?([\w.]+)", lambda raw, folder, suffix: [F.concat(_slashed(raw), F.lit(s)) for s in (".hs", ".lhs")]),
    Rule("elixir", r"(?mdU)^(?:alias|import|use|require)\s+([\w.]+)", _elixir),
    Rule("lua", r"""(?mdU)require\s*\(\s*['"]([^'"]+)['"]\s*\)""", lambda raw, folder, suffix: [F.concat(_slashed(raw), F.lit(".lua"))], "require"),
    Rule("shell", r"(?mdU)^(?:source|\.)\s+([^\s#;]+)", lambda raw, folder, suffix: [_near(raw, folder)], "source", clean=lambda raw: F.regexp_replace(raw, r"""\A["']+|["']+\z""", "")),
    Rule("r", r"""(?mdU)source\s*\(\s*['"]([^'"]+)['"]\s*\)""", lambda raw, folder, suffix: [_near(raw, folder)], "source"),
    Rule("ruby", r"""(?mdU)^\s*require_relative\s+['"]([^'"]+)['"]""", lambda raw, folder, suffix: [P.with_suffix(_near(raw, folder), ".rb")], "require_relative"),
    Rule("ruby", r"""(?mdU)^\s*require\s+['"]([^'"]+)['"]""", lambda raw, folder, suffix: [P.with_suffix(raw, ".rb"), P.with_suffix(F.concat(F.lit("lib/"), raw), ".rb")]),
    Rule("rust", r"(?mdU)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", lambda raw, folder, suffix: [_near(F.concat(raw, F.lit(".rs")), folder), _near(F.concat(raw, F.lit("/mod.rs")), folder)]),
    Rule("php", r"""(?mdU)(?:require_once|include_once|require|include)\s*\(?\s*['"]([^'"]+)['"]""", _php, "include"),
    Rule("php", r"(?mdU)^\s*use\s+([\w\\]+)\s*;", lambda raw, folder, suffix: [F.concat(F.replace(raw, F.lit("\\"), F.lit("/")), F.lit(".php"))]),
    Rule("c", r"""(?mdU)^\s*#\s*include\s*"([^"]+)\"""", lambda raw, folder, suffix: [_near(raw, folder), raw], "include"),
]


def _names(rule: Rule) -> Column:
    """All names of a text in the order of their matches."""
    if rule.inside:
        blocks = F.regexp_extract_all("text", F.lit(rule.inside), 1)
        return F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(rule.pattern), 1)))
    if rule.groups == 1:
        return F.regexp_extract_all("text", F.lit(rule.pattern), 1)
    # The text is searched once; the group is found in each match, which must not depend on what stands around it.
    group = lambda found, g: F.regexp_extract(found, rule.pattern, g)
    return F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), 0), lambda m: F.when(group(m, 1) != "", group(m, 1)).otherwise(group(m, 2)))


_WANTED = "array<struct<pos:bigint,raw:string,label:string,candidates:array<string>>>"


def _rule_column(k: int, rule: Rule) -> Column:
    """The names that one rule finds in a text, with their candidates."""
    folder, suffix = P.parent(F.col("rel_path")), F.col("suffix")

    def entry(found: Column, at: Column) -> Column:
        raw = rule.clean(found)
        options = rule.candidates(raw, folder, suffix)
        options = F.array(*options) if isinstance(options, list) else options
        paths = F.transform(options, lambda c: F.concat(P.normalise(c), F.when(c.endswith("/"), "/").otherwise("")))
        return F.struct((at + k * 1_000_000_000).cast("long").alias("pos"), raw.alias("raw"), F.lit(rule.label).cast("string").alias("label"), paths.alias("candidates"))

    found = F.transform(_names(rule), entry)
    return (F.filter(found, lambda x: rule.keep(x["raw"])) if rule.keep is not None else found).cast(_WANTED)


def wanted(files: DataFrame) -> DataFrame:
    """(src, pos, raw, label, candidates) of files (rel_path, suffix, importer, text).

    One projection holds the rules of every importer, so the files are read once, and a text is searched once by
    each rule of its importer; only the texts of Python files are handed to the parser.
    """
    bound_batches(files.sparkSession)
    column = F.array().cast(_WANTED)
    for importer in dict.fromkeys(rule.importer for rule in RULES):
        own = [_rule_column(k, rule) for k, rule in enumerate(RULES) if rule.importer == importer]
        column = F.when(F.col("importer") == importer, F.concat(*own) if len(own) > 1 else own[0]).otherwise(column)
    column = F.when(F.col("importer") == "python", _python_column(F.col("parsed"))).otherwise(column)
    readable = files.filter(F.col("text").isNotNull() & (F.col("importer") != "none"))
    parsed = import_column(F.when(F.col("importer") == "python", F.col("text")))["imports"]
    rows = readable.select("rel_path", "suffix", "importer", "text", parsed.alias("parsed"))
    return rows.select(F.col("rel_path").alias("src"), F.explode(column).alias("w")).select("src", "w.pos", "w.raw", "w.label", "w.candidates")


def _python_column(parsed: Column) -> Column:
    """The same of a Python file, from its syntax tree: absolute names from the root and then from
    the file's folder, relative ones from the folder that their dots name."""
    folder = P.parent(F.col("rel_path"))

    def entry(found: Column, at: Column) -> Column:
        module, level = found["module"], found["level"]
        tail = F.replace(module, F.lit("."), F.lit("/"))
        up = F.concat(folder, F.repeat(F.lit("/.."), F.greatest(level - 1, F.lit(0))))
        both = lambda base: [F.concat(base, F.lit("/"), tail, F.lit(".py")), F.concat(base, F.lit("/"), tail, F.lit("/__init__.py"))]
        options = F.when(module == "", F.array().cast("array<string>")).when(level > 0, F.array(*both(up))).otherwise(F.array(*both(F.lit(".")), *both(folder)))
        label = F.when(level > 0, F.lit("relative import"))
        return F.struct(at.cast("long").alias("pos"), F.concat(F.repeat(F.lit("."), level), module).alias("raw"), label.alias("label"), F.transform(options, P.normalise).alias("candidates"))

    return F.transform(parsed, entry).cast(_WANTED)


def _first_existing(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """(src, pos, dst): the first candidate of each name that exists."""
    options = rows.select("src", "pos", F.posexplode("candidates").alias("rank", "candidate")).filter(F.col("candidate").isNotNull())
    return options.join(listing.select(F.col("path").alias("candidate")), "candidate").groupBy("src", "pos").agg(F.regexp_replace(F.min_by("candidate", "rank"), "/$", "").alias("dst"))


def resolve(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """(src, dst, pos): distinct targets of each file at their first position."""
    return _first_existing(rows, listing).groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def unresolved(rows: DataFrame, listing: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_path, pos, message): names that must exist and don't, files that can't be read or parsed."""
    bound_batches(files.sparkSession)
    missing = rows.filter(F.col("label").isNotNull()).join(_first_existing(rows, listing).select("src", "pos"), ["src", "pos"], "left_anti")
    said = missing.select(F.col("src").alias("rel_path"), "pos", F.format_string("Unresolved %s '%s' in %s", "label", "raw", "src").alias("message"))
    broken = files.filter((F.col("importer") != "none") & F.col("text").isNull()).select("rel_path", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("UnicodeDecodeError in "), "rel_path").alias("message"))
    python = files.filter((F.col("importer") == "python") & F.col("text").isNotNull()).select("rel_path", F.lit(-1).cast("long").alias("pos"), import_column("text")["error"].alias("error")).filter("error IS NOT NULL")
    python = python.select("rel_path", "pos", F.concat(F.regexp_replace("error", "^SyntaxError: ", "SyntaxError in "), F.lit(" ("), "rel_path", F.lit(")")).alias("message"))
    return said.unionByName(broken).unionByName(python)


def listing(all_paths: DataFrame, path: str = "rel_path") -> DataFrame:
    """(path): every file, every directory, and every directory again with a slash."""
    files = all_paths.select(F.col(path).alias("path"))
    folders = all_paths.select(F.explode(P.ancestors(F.col(path))).alias("path")).distinct()
    return files.union(folders).union(folders.select(F.concat("path", F.lit("/"))))
