"""Rows of a few results as the text that a tool answers with."""

from __future__ import annotations

from collections.abc import Iterable


def hits(rows: Iterable, snippets: dict[str, str] | None = None) -> str:
    rows = list(rows)
    if not rows:
        return "Nothing is indexed yet."
    lines = ["No result is close to the question; treat what follows with care.\n"] if all(r.confidence == "low" for r in rows) else []
    lines += [f"- {r.file_path}:{r.start_line}-{r.end_line} ({r.confidence}, {r.distance:.3f})\n  {r.question}\n  note: {r.markdown_path}" + (f"\n  {text}" if (text := (snippets or {}).get(r.markdown_path)) else "") for r in rows]
    return "\n".join(lines)


def overview(rows: Iterable) -> str:
    lines = ["  " * r.depth + f"**{r.node_path}**" + (f" — {r.overview}" if r.overview else "") for r in rows]
    return "## Repository structure\n\n" + "\n".join(lines) if lines else "There are no notes, or no INDEX among them."


def todos(files: Iterable[str], markers: Iterable, commits: Iterable) -> str:
    """One section for each file, in the order given, whether it has anything or not."""
    by_file: dict[str, list[str]] = {}
    for r in markers:
        by_file.setdefault(r.file_path, []).append(f"- line {r.line_number} [{r.tag}] {r.text}")
    log: dict[str, list[str]] = {}
    for r in commits:
        log.setdefault(r.file_path, []).append(f"- {r.sha} {r.message}")
    parts = [f"### {f}\n" + "\n".join(by_file.get(f, ["- no markers"])) + "\n\nRecent commits:\n" + "\n".join(log.get(f, ["- none"])) for f in files]
    return "\n\n".join(parts) or "No files to look at."


def cost(row, suffixes: Iterable) -> str:
    kinds = ", ".join(f"{r.suffix} {r.n_files}" for r in suffixes)
    return f"{row.n_files} files ({kinds}), {row.n_dirs} directories, {row.n_chunks} chunks: about {row.n_calls} generator calls."


def plan(new: list[str], modified: list[str], deleted: list[str]) -> str:
    part = lambda title, paths: f"{title}: {len(paths)}" + "".join(f"\n  - {p}" for p in paths)
    return "\n".join([part("New", new), part("Modified", modified), part("Deleted", deleted)])


def scope(rows: Iterable[tuple[str, str, str]]) -> str:
    return "\n".join(f"{field}: {value or '-'} [{state}]" for field, value, state in rows)
