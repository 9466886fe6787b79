"""Notes of the graph as markdown, and the links that a note's text holds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

# Texts that stand for what is missing.
NO_SUMMARY = "<!-- summary placeholder -->"
NO_REPO_SUMMARY = "<!-- repo summary placeholder -->"
NO_LINKS = "_No internal imports found._"
NO_CHILDREN = "_Empty directory._"
NO_TOP = "_No top-level nodes._"
EMPTY_LIST = "  []"
RESERVED = ("type", "path", "links", "children")


def extra_lines(extra: Mapping[str, object] | None) -> str:
    """Further front matter; reserved keys are left to the note itself."""
    found = [T.front_matter_line(k, v) for k, v in (extra or {}).items() if k not in RESERVED]
    return "".join("\n" + x for x in found)


def _listed(rows: DataFrame, group: str, entry: Column) -> DataFrame:
    """Two joined lists of each group's rows in order: front-matter items and wikilinks."""
    sorted_rows = F.array_sort(F.collect_list(F.struct("pos", entry.alias("e"))))
    return rows.groupBy(group).agg(sorted_rows.alias("all"))


def _link(path: Column, kind: Column) -> Column:
    return F.when(kind == "file", P.without_suffix(path)).otherwise(path)


def _join(items: Column, before: str, after: str = "") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(before), x, F.lit(after))), "\n")


def _or(text: Column, other: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", other).otherwise(text)


def file_notes(files: DataFrame, links: DataFrame, extra: Mapping[str, object] | None = None, missing: str | None = NO_SUMMARY) -> DataFrame:
    """(path, note_path, content) of files (path, summary) and import edges (src, pos, dst).

    ``missing`` stands for an empty or null summary; with None summaries stay as they are, and a null one gives a null note.
    """
    found = _listed(links, "src", P.without_suffix(F.col("dst"))).select(F.col("src").alias("path"), F.col("all.e").alias("links"))
    rows = files.join(found, "path", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
    summary = F.col("summary") if missing is None else _or(F.col("summary"), missing)
    content = F.concat(
        F.lit("---\ntype: file\npath: "), "path", F.lit("\nlinks:\n"), _or(_join(F.col("links"), "  - "), EMPTY_LIST), F.lit(extra_lines(extra) + "\n---\n\n## "), P.name(F.col("path")),
        F.lit("\n\n"), summary, F.lit("\n\n## Connections\n"), _or(_join(F.col("links"), "- [[", "]]"), NO_LINKS), F.lit("\n"),
    )
    return rows.select("path", F.concat(P.without_suffix(F.col("path")), F.lit(".md")).alias("note_path"), content.alias("content"))


def directory_notes(dirs: DataFrame, children: DataFrame, extra: Mapping[str, object] | None = None) -> DataFrame:
    """(path, note_path, content) of directories (path, summary) and child edges (src, pos, dst, dst_type)."""
    entry = F.struct(F.col("dst").alias("path"), _link(F.col("dst"), F.col("dst_type")).alias("link"))
    found = _listed(children, "src", entry).select(F.col("src").alias("path"), F.col("all.e.path").alias("paths"), F.col("all.e.link").alias("links"))
    rows = dirs.join(found, "path", "left")
    content = F.concat(
        F.lit("---\ntype: directory\npath: "), "path", F.lit("\nchildren:\n"), _or(_join(F.col("paths"), "  - "), EMPTY_LIST), F.lit(extra_lines(extra) + "\n---\n\n"), _or(F.col("summary"), NO_SUMMARY),
        F.lit("\n\n## Contents\n"), _or(_join(F.col("links"), "- [[", "]]"), NO_CHILDREN), F.lit("\n"),
    )
    return rows.select("path", F.concat(P.without_suffix(F.col("path")), F.lit(".md")).alias("note_path"), content.alias("content"))


def index_note(top: DataFrame, extra: Mapping[str, object] | None = None) -> DataFrame:
    """The one note of the root, from (path, node_type, pos)."""
    links = F.transform(F.array_sort(F.collect_list(F.struct("pos", _link(F.col("path"), F.col("node_type")).alias("e")))), lambda x: x["e"])
    content = F.concat(F.lit("---\ntype: index" + extra_lines(extra) + f"\n---\n\n## Index\n\n{NO_REPO_SUMMARY}\n\n## Top Level\n"), _or(_join(F.col("links"), "- [[", "]]"), NO_TOP), F.lit("\n"))
    return top.agg(links.alias("links")).select(F.lit("INDEX").alias("path"), F.lit("INDEX.md").alias("note_path"), content.alias("content"))


def links_of(notes: DataFrame) -> DataFrame:
    """(src, pos, dst) from the texts of notes (node_path, content), by the type each one states."""
    note, kind = F.col("content"), T.scalar_field(F.col("content"), "type")
    found = F.when(kind == "file", T.list_field(note, "links")).when(kind == "directory", F.transform(T.list_field(note, "children"), P.without_suffix)).when(kind == "index", T.wikilinks(note)).otherwise(F.array().cast("array<string>"))
    return notes.select(F.col("node_path").alias("src"), F.posexplode(found).alias("pos", "dst")).withColumn("pos", F.col("pos").cast("long"))
