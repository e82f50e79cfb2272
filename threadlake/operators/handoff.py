"""Handoffs: what the next tool needs to know, from explicit facts only, within a token budget."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import text as t
from threadlake.functions.chronology import order_key
from threadlake.functions.identity import canonical_json, snapshot_id
from threadlake.operators.timeline import bounded_context

TOKEN_BUDGET, LEAST_BUDGET = 4000, 64
MOST_RECORDS = 128
LATEST = ("latest_user_request", "latest_assistant_reply")
FILE_KINDS = ("file_read", "file_write", "patch")


class HandoffError(ValueError):
    """A handoff that can't be made."""


def redact(text: str) -> str:
    """The column function's twin for single texts."""
    out = []
    for word in text.split():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
        out.append(t.REDACTED if low.startswith(t.SECRET_START) or any(p in low for p in t.SECRET_PARTS) else word)
    return " ".join(out)


def fact_text(payload: Mapping) -> str | None:
    """A payload's first text field, redacted; a blank one doesn't fall through to the next."""
    value = next((payload[f] for f in t.FACT_FIELDS if isinstance(payload.get(f), str)), None)
    return None if value is None else redact(value) or None


class Facts:
    """What events say, with the event that said each thing first."""

    def __init__(self) -> None:
        self.sets: dict[str, set[str]] = {f: set() for f in ("decisions", "completed", "open_tasks", "relevant_files")}
        self.provenance: list[dict] = []
        self.tests = {"passed": 0, "failed": 0, "failing": []}
        self.latest: dict[str, tuple[str, str]] = {}

    def put(self, field: str, value: str | None, event_id: str) -> None:
        if value is not None and value not in self.sets[field]:
            self.sets[field].add(value)
            self.provenance.append({"event_id": event_id, "field": field})

    def read(self, event_id: str, kind: str, payload: Mapping) -> None:
        text = fact_text(payload)
        if kind == "user_message" and text:
            self.latest["latest_user_request"] = (text, event_id)
        elif kind == "assistant_message" and text:
            self.latest["latest_assistant_reply"] = (text, event_id)
        elif kind == "decision":
            self.put("decisions", text, event_id)
        elif kind in ("task", "plan"):
            status = payload.get("status")
            self.put("completed" if isinstance(status, str) and status.lower() == "completed" else "open_tasks", text, event_id)
        elif kind in FILE_KINDS and isinstance(payload.get("path"), str):
            self.put("relevant_files", payload["path"], event_id)
        elif kind == "command_result":
            passed, failed = payload.get("passed"), payload.get("failed")
            if all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in (passed, failed)):
                failing = payload.get("failing")
                self.tests = {"passed": passed, "failed": failed, "failing": [redact(x) for x in failing if isinstance(x, str)] if isinstance(failing, list) else []}
                self.provenance.append({"event_id": event_id, "field": "tests"})


def generate(global_id: str, objective: str, events: Sequence[Mapping], records: Sequence[Mapping] = (), branch: str | None = None, head: str | None = None, dirty: bool = False, budget: int = TOKEN_BUDGET, suggest: Callable[[str], str] | None = None) -> dict:
    """A handoff document. events: event_id, kind and payload, in order. records: newest first."""
    if not global_id.startswith("gs_"):
        raise HandoffError("not a global session")
    if not objective.strip():
        raise HandoffError("no objective")
    facts = Facts()
    for e in events:
        facts.read(e["event_id"], e["kind"], e["payload"])
    lists = {f: sorted(v) for f, v in facts.sets.items()}
    latest = {}
    for field in LATEST:
        if field in facts.latest:
            latest[field], event_id = facts.latest[field]
            facts.provenance.append({"event_id": event_id, "field": field})
    next_action = lists["open_tasks"][0] if lists["open_tasks"] else "Review the latest user request" if "latest_user_request" in latest else "Review the latest verified state"
    for r in records:
        field = {"decision": "decisions", "task": "open_tasks"}.get(r["kind"])
        content = redact(r["content"])
        if field and content and content not in lists[field]:
            lists[field].append(content)
            facts.provenance.append({"event_id": r["provenance_id"], "field": field})
    if lists["open_tasks"]:
        next_action = lists["open_tasks"][0]
    if suggest is not None and not lists["open_tasks"]:
        lists["open_tasks"], next_action = _suggested(suggest, objective, events, next_action)
    if not facts.provenance:
        raise HandoffError("nothing to refer to")
    short = lambda x: t.cut_bytes(x, t.EXCERPT_BYTES)[0]
    done, todo = len(lists["completed"]), len(lists["open_tasks"])
    document = {
        "schema_version": "1.1",
        "global_session_id": global_id,
        "objective": short(redact(objective)),
        "status": {"phase": "implementation" if todo else "verification" if done else "unknown", "completion": done * 100 // (done + todo) if done + todo else 0},
        "decisions": [short(x) for x in lists["decisions"]],
        "completed": [short(x) for x in lists["completed"]],
        "open_tasks": [short(x) for x in lists["open_tasks"]],
        "repository": {"branch": branch, "head": head, "dirty": dirty},
        "tests": facts.tests,
        "relevant_files": lists["relevant_files"],
        "next_action": short(next_action),
        **{field: short(latest[field]) for field in LATEST if field in latest},
        "provenance": facts.provenance,
    }
    fit_budget(document, budget)
    return document


def _suggested(suggest: Callable[[str], str], objective: str, events: Sequence[Mapping], next_action: str) -> tuple[list[str], str]:
    """What a model suggests where no task is known; anything unreadable is left out."""
    seen = [x for e in events if (x := fact_text(e["payload"]))]
    try:
        answer = json.loads(suggest(json.dumps({"objective": redact(objective), "observations": seen}, ensure_ascii=False)))
        tasks = [redact(x) for x in answer.get("open_tasks", []) if isinstance(x, str) and x.strip()]
        chosen = answer.get("next_action")
        return tasks, redact(chosen) if isinstance(chosen, str) else next_action
    except (ValueError, TypeError, AttributeError, OSError):
        return [], next_action


def approximate_tokens(document: Mapping) -> int:
    return -(-len(canonical_json(document).encode()) // 4)


def fit_budget(document: dict, budget: int) -> None:
    """Drops what matters least until the document fits, each time with its last reference.

    Sizes are measured once; each step takes off what it drops, so that the time
    is linear in the document.
    """
    if budget < LEAST_BUDGET:
        raise HandoffError("the budget is too small")
    octets = lambda x: len(canonical_json(x).encode())
    size = octets(document)
    if -(-size // 4) <= budget:
        return
    lists = {f: list(map(octets, document[f])) for f in ("relevant_files", "completed", "decisions", "open_tasks")}
    references = document["provenance"]
    said: dict[str, list[int]] = {}
    for i, r in enumerate(references):
        said.setdefault(r["field"], []).append(i)
    gone: set[int] = set()
    while -(-size // 4) > budget:
        field = next((f for f in ("relevant_files", "completed", "decisions") if lists[f]), None)
        if field is None and len(lists["open_tasks"]) > 1:
            field = "open_tasks"
        if field is not None:
            size -= lists[field].pop() + bool(lists[field])  # with its comma
        elif len(references) - len(gone) > 1:
            field = next((f for f in reversed(LATEST) if f in document), None)
            if field is not None:
                size -= octets(field) + octets(document.pop(field)) + 2
        if field is None:
            raise HandoffError("the budget is too small")
        if said.get(field):
            i = said[field].pop()
            gone.add(i)
            size -= octets(references[i]) + (len(gone) < len(references))
    for f, kept in lists.items():
        del document[f][len(kept) :]
    document["provenance"] = [r for i, r in enumerate(references) if i not in gone]


def handoffs(log: DataFrame, members: DataFrame, globals_: DataFrame, records: DataFrame | None = None, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(global_id, handoff_id, snapshot_id, created_at, document) for each global session.

    members(global_id, native_session_id), globals_(global_id, objective,
    updated_at), records(global_id, kind, content, provenance_id, created_at).
    Each task gets a bounded context: at most 256 events and 4 MiB, and 128
    records. A session that can't be summed up is left out.
    """
    context = bounded_context(log.join(members.select("global_id", "native_session_id"), "native_session_id"), group="global_id")
    for c in ("branch", "head"):
        if c not in context.columns:
            context = context.withColumn(c, F.lit(None).cast("string"))
    dirty = F.get_json_object("payload_json", "$.dirty")
    ordered = context.select("global_id", order_key().alias("at"), "event_id", "kind", "payload_json", "branch", "head", F.when(dirty.isin("true", "false"), dirty == "true").alias("dirty"))
    events = ordered.groupBy("global_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "kind", "payload_json"))).alias("events"), *repository_state())
    events = events.select("global_id", "branch", "head", "dirty", F.transform("events", lambda e: F.struct(e["event_id"].alias("event_id"), e["kind"].alias("kind"), e["payload_json"].alias("payload_json"))).alias("events"))
    rows = globals_.select("global_id", "objective", "updated_at").join(events, "global_id", "left")
    if records is not None:
        from pyspark.sql import Window

        newest = records.withColumn("rn", F.row_number().over(Window.partitionBy("global_id").orderBy(F.col("created_at").desc(), F.col("provenance_id").desc()))).where(F.col("rn") <= MOST_RECORDS)
        listed = newest.groupBy("global_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("rn")).alias("o"), "kind", "content", "provenance_id")), asc=False).alias("records"))
        rows = rows.join(listed.select("global_id", F.to_json("records").alias("records")), "global_id", "left")
    else:
        rows = rows.withColumn("records", F.lit(None).cast("string"))
    rows = rows.withColumn("events", F.to_json(F.coalesce("events", F.array().cast("array<struct<event_id:string,kind:string,payload_json:string>>"))))

    def run(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples():
                events = [{"event_id": e["event_id"], "kind": e["kind"], "payload": _object(e.get("payload_json"))} for e in json.loads(r.events)]
                try:
                    document = generate(r.global_id, r.objective or "", events, json.loads(r.records) if r.records else (), r.branch, r.head, r.dirty is not None and bool(r.dirty), budget=budget)
                except HandoffError:
                    continue
                snapshot = snapshot_id(document)
                out.append((r.global_id, "handoff_" + snapshot.removeprefix("snapshot_"), snapshot, r.updated_at or "", canonical_json(document)))
            yield pd.DataFrame(out, columns=["global_id", "handoff_id", "snapshot_id", "created_at", "document"])

    return rows.mapInPandas(run, "global_id string, handoff_id string, snapshot_id string, created_at string, document string")


def repository_state() -> list[Column]:
    """Aggregates of ordered events (at, branch, head, dirty): the last value of each that is there."""
    return [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in ("branch", "head", "dirty")]


def _object(text: str | None) -> dict:
    try:
        value = json.loads(text or "{}")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def fact_sets(log: DataFrame) -> DataFrame:
    """Sorted distinct decisions, completed and open tasks and files of each session, without Python."""
    kind, text = F.col("kind"), t.redact(t.first_string(F.col("payload_json"), t.FACT_FIELDS))
    done = F.lower(t.payload_string(F.col("payload_json"), "status")) == "completed"
    rows = log.select("native_session_id", "kind", F.when(text != "", text).alias("fact"), F.coalesce(done, F.lit(False)).alias("done"), t.payload_string(F.col("payload_json"), "path").alias("path"))
    some = lambda value, when: F.array_sort(F.collect_set(F.when(when, value)))
    planned = F.col("kind").isin("task", "plan")
    return rows.groupBy("native_session_id").agg(
        some(F.col("fact"), kind == "decision").alias("decisions"),
        some(F.col("fact"), planned & F.col("done")).alias("completed"),
        some(F.col("fact"), planned & ~F.col("done")).alias("open_tasks"),
        some(F.col("path"), kind.isin(*FILE_KINDS)).alias("relevant_files"),
    )


def latest_texts(log: DataFrame) -> DataFrame:
    """The last user and assistant texts of each session, redacted."""
    key = order_key()
    text = t.redact(t.first_string(F.col("payload_json"), t.FACT_FIELDS))
    rows = log.withColumn("fact", F.when(text != "", text))
    pick = lambda kind: F.max_by("fact", F.when((F.col("kind") == kind) & F.col("fact").isNotNull(), key))
    return rows.groupBy("native_session_id").agg(pick("user_message").alias("latest_user_request"), pick("assistant_message").alias("latest_assistant_reply"))


def latest_handoff(rows: DataFrame) -> DataFrame:
    """Of each global session, the handoff of greatest (created_at, handoff_id)."""
    return rows.groupBy("global_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "global_id")), F.struct("created_at", "handoff_id")).alias("h")).select("global_id", "h.*")


def stale(handoff_rows: DataFrame, globals_: DataFrame) -> DataFrame:
    """Whether a handoff is older than its session, compared as text."""
    return handoff_rows.join(globals_.select("global_id", "updated_at"), "global_id").withColumn("stale", F.col("created_at") < F.col("updated_at"))


def current_context(members: DataFrame, globals_: DataFrame) -> DataFrame:
    """Global sessions with their members."""
    listed = members.groupBy("global_id").agg(F.array_sort(F.collect_list("native_session_id")).alias("members"))
    return globals_.join(listed, "global_id", "left")


def newest_records(records: DataFrame, global_id: str) -> DataFrame:
    return records.where(F.col("global_id") == global_id).orderBy(F.col("created_at").desc(), F.col("provenance_id").desc()).limit(MOST_RECORDS)


