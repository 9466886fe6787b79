"""Column expressions over POSIX paths relative to a repository root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Path components; arrays of strings sort the way paths do."""
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix(path: Column) -> Column:
    """The last suffix with its dot, case kept; empty for none and for a leading-dot name."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    """The containing directory; ``.`` at the root."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "/")).otherwise(".")


def without_suffix(path: Column) -> Column:
    """The note id of a file: the path without its last suffix."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def with_suffix(path: Column, new: Column | str) -> Column:
    return F.concat(without_suffix(path), F.lit(new) if isinstance(new, str) else new)


def ancestors(path: Column) -> Column:
    """Every proper prefix directory, shallow to deep; empty at the root."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def join(base: Column, tail: Column) -> Column:
    """``base/tail``; a base of ``.`` is the root."""
    return F.when((base == ".") | (base == ""), tail).otherwise(F.concat(base, F.lit("/"), tail))


def normalise(path: Column) -> Column:
    """``.`` and ``..`` resolved; null if the path leaves the root or is absolute."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("kept"), F.lit(True).alias("inside"))

    def step(state: Column, part: Column) -> Column:
        kept, inside = state["kept"], state["inside"]
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.struct(
            F.when((part == "") | (part == "."), kept).when(part == "..", shorter).otherwise(F.concat(kept, F.array(part))).alias("kept"),
            (inside & ~((part == "..") & (F.size(kept) == 0))).alias("inside"),
        )

    def finish(found: Column) -> Column:
        return F.when(found["inside"], F.when(F.size(found["kept"]) == 0, ".").otherwise(F.array_join(found["kept"], "/")))

    return F.when(~path.startswith("/"), F.aggregate(parts(path), start, step, finish))


def absolute(path: Column, root: str) -> Column:
    """An absolute path as it is, any other below ``root``."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def relative_if_below(path: Column, root: str) -> Column:
    """Relative to ``root`` if it lies below it by components, else unchanged."""
    base = root.rstrip("/")
    return F.when(path == base, ".").when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 1 << 30)).otherwise(path)


def snake_case(text: Column) -> Column:
    """``_`` before each capital but the first character, all lower case."""
    return F.lower(F.regexp_replace(text, r"(?<!^)(?=[A-Z])", "_"))
