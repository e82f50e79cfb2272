"""The file that names a project's current session, and the identity of a git checkout."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
from dataclasses import asdict, dataclass
from pathlib import Path

from threadlake.functions.identity import sha256

FOLDER, NAME = ".threadlake", "current.json"


class MarkerError(ValueError):
    """A marker that doesn't have the one shape it may have."""


@dataclass(frozen=True)
class Marker:
    schema_version: str
    global_session_id: str


def read_marker(root: str) -> Marker | None:
    """The marker below a project's root; None if there is none."""
    path = Path(root) / FOLDER / NAME
    if not path.is_file():
        return None
    try:
        value = json.loads(path.read_text(encoding="utf-8"))
    except ValueError as e:
        raise MarkerError("unreadable marker") from e
    if not isinstance(value, dict) or set(value) != {"schema_version", "global_session_id"} or not all(isinstance(v, str) for v in value.values()) or not value["global_session_id"].startswith("gs_"):
        raise MarkerError("unexpected marker")
    return Marker(**value)


def write_marker(root: str, marker: Marker) -> None:
    """Replaces the marker as a whole."""
    folder = Path(root) / FOLDER
    folder.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(asdict(marker), f)
    os.replace(temporary, folder / NAME)


@dataclass(frozen=True)
class Repository:
    repository_id: str
    worktree: str
    branch: str | None
    head: str | None


def _git(path: str, *arguments: str) -> str | None:
    done = subprocess.run(["git", "-C", path, *arguments], capture_output=True, text=True, check=False)
    return done.stdout.strip() or None if done.returncode == 0 else None


def repository(path: str) -> Repository | None:
    """Identity of the checkout around a path; worktrees of one repository share its id."""
    common, top = _git(path, "rev-parse", "--path-format=absolute", "--git-common-dir"), _git(path, "rev-parse", "--show-toplevel")
    if common is None or top is None:
        return None
    branch = _git(path, "symbolic-ref", "--short", "-q", "HEAD")
    return Repository("repo_" + sha256(os.path.realpath(common))[:24], os.path.realpath(top), branch, _git(path, "rev-parse", "--verify", "-q", "HEAD"))


def commits_related(path: str, a: str, b: str) -> bool:
    """Whether one commit is an ancestor of the other."""
    return any(subprocess.run(["git", "-C", path, "merge-base", "--is-ancestor", x, y], capture_output=True, check=False).returncode == 0 for x, y in ((a, b), (b, a)))
