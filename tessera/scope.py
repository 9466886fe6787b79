"""Where an engine works: the note folder, the index folder and the repository."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

PACKAGE = Path(__file__).resolve().parent

# Environment variables that name a field when nothing else does.
ENVIRONMENT = {"vault_root": "VAULT_ROOT", "index_path": "INDEX_PATH", "repo_root": "REPO_ROOT", "guidelines": "GUIDELINES_PATH"}


class ScopeError(RuntimeError):
    """A field is missing, or points into this package."""


def resolve(field: str, override: str | None = None) -> str:
    """The override, else the environment; an error that names the variable if neither is set."""
    value = override or os.environ.get(ENVIRONMENT[field])
    if not value:
        raise ScopeError(f"{field} is not set: pass it or set {ENVIRONMENT[field]}")
    return guard(value)


def is_own(path: str) -> bool:
    """Whether a path is this package's folder or lies below it."""
    found = Path(path).expanduser().resolve()
    return found == PACKAGE or PACKAGE in found.parents


def guard(path: str) -> str:
    if "://" not in path and is_own(path):
        raise ScopeError(f"{path} lies inside the engine's own package; choose another target")
    return path


@dataclass(frozen=True)
class Scope:
    """Overrides for the three fields; None leaves a field to the environment."""

    vault_root: str | None = None
    index_path: str | None = None
    repo_root: str | None = None

    def get(self, field: str) -> str:
        return resolve(field, getattr(self, field))

    def status(self) -> list[tuple[str, str, str]]:
        """(field, value, OK | SELF-SCOPE | MISSING) for each field."""
        out = []
        for field in ("vault_root", "index_path", "repo_root"):
            value = getattr(self, field) or os.environ.get(ENVIRONMENT[field]) or ""
            out.append((field, value, "MISSING" if not value else "SELF-SCOPE" if "://" not in value and is_own(value) else "OK"))
        return out
