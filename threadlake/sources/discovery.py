"""Finds the session files of each tool."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLLOUT = re.compile(r"sessions/\d+/\d+/\d+/rollout-[^/]*\.jsonl$")


@dataclass(frozen=True)
class Found:
    """A file of a tool, and what could be learned of it without reading it."""

    path: str
    family: str
    kind: str
    size: int = 0
    readable: bool = True
    mode: int = 0


@dataclass
class Report:
    sources: list[Found] = field(default_factory=list)
    diagnostics: list[str] = field(default_factory=list)


def _found(path: Path, family: str, kind: str) -> Found:
    status = path.stat()
    return Found(str(path), family, kind, status.st_size, os.access(path, os.R_OK), status.st_mode & 0o777)


def expand(path: str, home: str, environment: Mapping[str, str]) -> str:
    """A leading ~ and variables $NAME and ${NAME}; ValueError for an unknown one. No other shell syntax."""
    if path == "~" or path.startswith("~/"):
        path = home + path[1:]

    def put(m: re.Match) -> str:
        name = m[1] or m[2]
        if name not in environment:
            raise ValueError(f"unknown variable {name}")
        return environment[name]

    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", put, path)


def rollout_homes(explicit: list[str], environment: Mapping[str, str], home: str, variable: str = "CODEX_HOME", default: str = ".codex") -> list[str]:
    """Explicit homes, else the environment's, else the default."""
    if explicit:
        return explicit
    return [environment[variable]] if environment.get(variable) else [str(Path(home) / default)]


def discover_rollouts(homes: list[str]) -> Report:
    """Rollouts at sessions/YYYY/MM/DD/ and the session index of each home, every file once."""
    report, seen = Report(), set()
    for home in homes:
        root = Path(home)
        if not root.is_dir():
            report.diagnostics.append(f"missing home {home}")
            continue
        files = [(p, "rollout") for p in sorted(root.glob("sessions/*/*/*/rollout-*.jsonl")) if ROLLOUT.search(str(p))]
        index = root / "session_index.jsonl"
        for path, kind in [*files, *([(index, "index")] if index.is_file() else [])]:
            real = path.resolve()
            if real not in seen:
                seen.add(real)
                report.sources.append(_found(path, "codex", kind))
    report.diagnostics.sort()
    return report


def _files(root: Path, pattern: str, family: str, skip: tuple[str, ...] = ()) -> list[Found]:
    return [_found(p, family, "transcript") for p in sorted(root.glob(pattern)) if p.is_file() and p.name not in skip]


def discover_external(home: str) -> list[Found]:
    """The files of all other tools below a home."""
    root = Path(home)
    return [
        *_files(root, ".claude/projects/**/*.jsonl", "claude-code"),
        *_files(root, ".continue/sessions/**/*.json", "continue", ("sessions.json",)),
        *_files(root, ".gemini/**/history.jsonl", "agy"),
        *_files(root, ".grok/sessions/*/*/updates.jsonl", "grok"),
        *_files(root, ".local/share/opencode/*.db", "opencode"),
    ]


def index_health(spark: SparkSession, path: str) -> DataFrame:
    """Valid and malformed objects of a session index."""
    value = F.try_parse_json("value")
    good = F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))
    lines = spark.read.text(path, lineSep="\n").where(F.trim("value") != "")
    return lines.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("malformed"))


def unchanged(stamps: Mapping[str, tuple[int, int]], path: str) -> bool:
    """Whether a file's size and time are as remembered."""
    status = os.stat(path)
    return stamps.get(path) == (status.st_size, status.st_mtime_ns)
