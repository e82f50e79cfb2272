"""Batches as collectors send them: encoding, limits and verification."""

from __future__ import annotations

import base64
import hmac
import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from threadlake.functions.identity import event_id, raw_id, sha256

MOST_BYTES, MOST_EVENTS, PER_MINUTE = 10 << 20, 5000, 60
RETRIES, BACKOFF_MS = 5, 200


class BatchError(ValueError):
    """A batch that is refused as a whole."""


def encode(source_id: str, raws: list[dict], events: list[dict], cursor: dict) -> str:
    """A batch as JSON text: bytes in base64, events as JSON strings."""
    coded = [r | {"bytes": base64.b64encode(r["bytes"]).decode()} for r in raws]
    return json.dumps({"source_id": source_id, "raw_objects": coded, "events": [json.dumps(e) for e in events], "cursor": cursor})


def decode(body: str) -> dict:
    """The batch; BatchError unless it is within limits and every identity is right.

    Raw identities of both forms are accepted, offsets counted either way.
    """
    if len(body.encode()) > MOST_BYTES:
        raise BatchError("too many bytes")
    try:
        batch = json.loads(body)
        raws = [r | {"bytes": base64.b64decode(r["bytes"], validate=True)} for r in batch["raw_objects"]]
        events = [json.loads(e) for e in batch["events"]]
    except (ValueError, KeyError, TypeError) as e:
        raise BatchError("unreadable batch") from e
    if len(events) > MOST_EVENTS:
        raise BatchError("too many events")
    for e in events:
        check_event(e)
    for r in raws:
        if r["id"] not in (raw_id(r["generation"], r["offset"], r["bytes"], external) for external in (False, True)):
            raise BatchError("raw identity mismatch")
    return {"source_id": batch["source_id"], "raw_objects": raws, "events": events, "cursor": batch["cursor"]}


FIELDS = frozenset(("schema_version", "event_id", "tool", "native_session_id", "sequence", "timestamp", "timestamp_precision", "kind", "workspace", "payload", "provenance"))


def check_event(e: dict) -> None:
    """BatchError unless an event is complete, strict and named as it should be."""
    if set(e) - FIELDS or FIELDS - set(e) - {"workspace"}:
        raise BatchError("unexpected or missing fields")
    names = [*e["tool"].values(), e["native_session_id"], *(e["provenance"].get(k) for k in ("source_path", "source_generation", "adapter_version"))]
    confidence = e["provenance"].get("ordering_confidence")
    if not all(isinstance(n, str) and n for n in names) or e["sequence"] < 0 or e["provenance"]["source_offset"] < 0 or confidence is not None and not 0 <= confidence <= 1:
        raise BatchError("invalid event")
    if event_id(e) != e["event_id"]:
        raise BatchError("event identity mismatch")


def scoped(collector: str, source_id: str) -> str:
    return f"collector:{collector}:{source_id}"


@dataclass
class Collectors:
    """Issued, authenticated and revoked by the hashes of their tokens; a log of what happened."""

    log: list[dict] = field(default_factory=list)

    def issue(self, label: str, created_at: str, token: str | None = None) -> tuple[str, str]:
        """(id, token); the token is shown this once."""
        token = token or base64.urlsafe_b64encode(random.SystemRandom().randbytes(32)).decode().rstrip("=")
        name = "collector_" + sha256(token)[:24]
        self.log.append({"id": name, "label": label, "token_hash": sha256(token), "at": created_at, "action": "issue"})
        return name, token

    def authenticate(self, token: str) -> str | None:
        gone = {x["id"] for x in self.log if x["action"] == "revoke"}
        for x in self.log:
            if x["action"] == "issue" and x["id"] not in gone and hmac.compare_digest(x["token_hash"], sha256(token)):
                return x["id"]
        return None

    def revoke(self, name: str, at: str) -> bool:
        known = any(x["id"] == name and x["action"] == "issue" for x in self.log)
        if not known or any(x["id"] == name and x["action"] == "revoke" for x in self.log):
            return False
        self.log.append({"id": name, "action": "revoke", "at": at})
        return True


class TokenBucket:
    """So many requests a minute, refilled all the time."""

    def __init__(self, per_minute: int = PER_MINUTE) -> None:
        self.per_minute, self.state = per_minute, {}

    def allow(self, name: str, now: float) -> bool:
        tokens, last = self.state.get(name, (float(self.per_minute), now))
        tokens = min(float(self.per_minute), tokens + (now - last) * self.per_minute / 60)
        self.state[name] = (tokens - 1 if tokens >= 1 else tokens, now)
        return tokens >= 1


def retry_delay(attempt: int, status: int | None, most: int = RETRIES) -> int | None:
    """Milliseconds until the next try after a failure without status, or with one that may pass; else None."""
    passing = status is None or status == 429 or status >= 500
    return BACKOFF_MS * 2**attempt if passing and attempt < most else None


def with_retry(call: Callable[[], tuple[int | None, object]], sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result once its status is below 400; RuntimeError when tries run out."""
    attempt = 0
    while True:
        status, value = call()
        if status is not None and status < 400:
            return value
        delay = retry_delay(attempt, status)
        if delay is None:
            raise RuntimeError(f"gave up with status {status}")
        sleep(delay / 1000)
        attempt += 1
