"""Canonical JSON and every derived identifier."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(x: float) -> str:
    """A double as shortest round-trip text: exponents from 1e16 and below 1e-5, without padding or plus."""
    if math.isnan(x) or math.isinf(x):
        return "null"
    text = repr(x)
    if "e" in text:
        mantissa, exponent = text.split("e")
        return f"{mantissa}e{int(exponent)}"
    if x and (abs(x) >= 1e16 or abs(x) < 1e-5):
        mantissa, exponent = f"{x:e}".split("e")
        return f"{mantissa.rstrip('0').rstrip('.')}e{int(exponent)}"
    return text


def canonical_json(value: object) -> str:
    """Compact JSON, the keys of nested mappings sorted; top-level mappings keep their order of insertion.

    Use :func:`sorted_keys` first where the top level must be sorted too.
    """
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, Mapping):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(canonical_json, value)) + "]"


def sorted_keys(value: object) -> object:
    """The value with the keys of all its mappings in order."""
    if isinstance(value, Mapping):
        return {k: sorted_keys(value[k]) for k in sorted(value)}
    if isinstance(value, list | tuple):
        return [sorted_keys(v) for v in value]
    return value


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def event_id(draft: Mapping) -> str:
    """The identity of an event: what was said, where in its source, but not who read it or from which path."""
    tool, workspace, provenance = draft["tool"], draft.get("workspace"), draft["provenance"]
    identity = {
        "schema_version": draft["schema_version"],
        "tool": {k: tool[k] for k in ("family", "surface", "profile")},
        "native_session_id": draft["native_session_id"],
        "sequence": draft["sequence"],
        "timestamp": draft["timestamp"],
        "timestamp_precision": draft["timestamp_precision"],
        "kind": draft["kind"],
        "workspace": None if workspace is None else {k: workspace.get(k) for k in ("cwd", "repository_id", "branch", "head")},
        "payload": sorted_keys(draft["payload"]),
        "source_generation": provenance["source_generation"],
        "source_offset": provenance["source_offset"],
    }
    return "sha256:" + sha256(canonical_json(identity))


def raw_id(generation: str, offset: int, data: bytes, external: bool = False) -> str:
    """Of a raw record: external tools count the offset little-endian and have a prefix of their own."""
    body = generation.encode() + offset.to_bytes(8, "little" if external else "big") + data
    return ("raw_" if external else "sha256:") + sha256(body)


def stable_offset(name: str) -> int:
    """63 bits of a hash, for sources without byte offsets."""
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little") & (1 << 63) - 1


def length_prefixed(parts: list[str]) -> str:
    """Hex hash of texts, each behind its length, so that no two lists run together."""
    return sha256(b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts))


def global_id(native: str | Column) -> str | Column:
    """Of the global session that a native one seeds."""
    if isinstance(native, str):
        return "gs_" + sha256(native)[:32]
    return F.concat(F.lit("gs_"), F.substring(F.sha2(native, 256), 1, 32))


def candidate_id(a: str | Column, b: str | Column) -> str | Column:
    """Of an unordered pair of sessions."""
    if isinstance(a, str):
        return "candidate_" + sha256(min(a, b) + "\0" + max(a, b))[:32]
    return F.concat(F.lit("candidate_"), F.substring(F.sha2(F.concat(F.least(a, b), F.lit("\0"), F.greatest(a, b)), 256), 1, 32))


def snapshot_id(document: Mapping) -> str:
    return "snapshot_" + sha256(canonical_json(document))




def event_ids(events_json: Column) -> Column:
    """Identities of events given as JSON drafts, in Arrow batches."""

    def run(drafts: pd.Series) -> pd.Series:
        return drafts.map(lambda d: event_id(json.loads(d)))

    return F.pandas_udf(run, "string")(events_json)


def canonical_payload(payload: Column) -> Column:
    """Payload JSON with sorted keys and canonical numbers; null stays."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else canonical_json(sorted_keys(json.loads(t))))

    return F.pandas_udf(run, "string")(payload)
