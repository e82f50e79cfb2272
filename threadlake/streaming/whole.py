"""All of it: what is discovered below a home is read, indexed, reconciled and handed over."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from threadlake.functions.identity import sha256
from threadlake.sources import discovery
from threadlake.streaming import index, ingest, reconcile
from threadlake.streaming.store import Store

# Where each tool keeps its sessions below a home.
PATTERNS = {
    "codex": ".codex/sessions/*/*/*/rollout-*.jsonl",
    "claude-code": ".claude/projects/**/*.jsonl",
    "continue": ".continue/sessions/**/*.json",
    "agy": ".gemini/**/history.jsonl",
    "grok": ".grok/sessions/*/*/updates.jsonl",
}


@dataclass
class Round:
    """What one round found: streams by tool, and what discovery had to say."""

    sources: list[tuple[str, str]] = field(default_factory=list)
    diagnostics: list[str] = field(default_factory=list)


def sources(home: str) -> Round:
    """(family, path or pattern) of each tool that has files below a home."""
    out = Round()
    rollouts = discovery.discover_rollouts([f"{home}/.codex"])
    out.diagnostics = rollouts.diagnostics
    found = {f.family for f in discovery.discover_external(home)} | {f.family for f in rollouts.sources if f.kind == "rollout"}
    out.sources = [(family, f"{home}/{pattern}") for family, pattern in PATTERNS.items() if family in found]
    out.sources += [("opencode", f.path) for f in discovery.discover_external(home) if f.family == "opencode"]
    return out


def run_once(spark: SparkSession, home: str, store: Store, checkpoints: str, **options) -> Round:
    """One round: every stream until it has caught up, then the index, then memberships and handoffs.

    Each step is a stream of its own with its own checkpoint, so a round that
    breaks off is gone on with by the next one.
    """
    found = sources(home)
    for family, where in found.sources:
        ingest.ingest(spark, where, family, store, f"{checkpoints}/{family}-{sha256(where)[:12]}", **options).awaitTermination()
    index.index_stream(store, f"{checkpoints}/index").awaitTermination()
    reconcile.reconcile_now(store, f"{checkpoints}/reconcile")
    return found
