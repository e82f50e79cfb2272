"""Structured Streaming from session files to the event store."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from threadlake.functions.identity import canonical_json, sha256, sorted_keys
from threadlake.plans.lineage import settled
from threadlake.sources import records as rec
from threadlake.sources import snapshots, tail, wire
from threadlake.streaming.store import CURSORS, EVENTS, RAWS, Store, with_times

SCAN_SECONDS, RECONCILE_SECONDS, PAGE = 2, 30, 200
PARSERS = {"codex": rec.parse_rollout, "claude-code": rec.parse_claude, "agy": rec.parse_agy, "grok": rec.parse_grok}
PARSED = "path string, source_generation string, source_offset bigint, raw binary, raw_object_id string, blob_hash string, issue string, event string, call_id string, next_sequence bigint, state string, sensitive array<string>"
#: Bytes of a stream's batch at most, but for one line a file.
BATCH_BYTES = 1 << 30
LAST = ("cwd", "branch", "head", "session")
FILE = ["path", "generation"]
RANGE = [*FILE, "range"]
FACTS = "path string, generation string, range bigint, first bigint, n bigint, " + ", ".join(f"{c} string, {c}_at bigint" for c in LAST) + ", calls array<string>, asked array<string>, bad bigint"


def range_facts(lines: DataFrame, family: str, chunk: int) -> DataFrame:
    """What each range of ``chunk`` bytes of a file says about later ones (rec.Facts), without moving a line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: dict[tuple, list] = {}
            for path, generation, at, value in zip(frame["path"], frame["generation"], frame["source_offset"], frame["value"], strict=True):
                place = found.setdefault((path, generation, at // chunk), [at, rec.Facts()])
                place[0] = min(place[0], at)
                place[1].read(family, int(at), bytes(value))
            rows = [(*key, at, f.n, *(x for c in LAST for x in (f.last.get(c, (None, None))[::-1])), sorted(f.calls), sorted(f.asked), f.bad) for key, (at, f) in found.items()]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FACTS.split(", ")])

    parts = lines.select(*FILE, "source_offset", "value").mapInPandas(run, FACTS)
    said = [x for c in LAST for x in (F.max_by(c, f"{c}_at").alias(c),)]
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return settled(parts.groupBy(*RANGE).agg(F.min("first").alias("first"), F.sum("n").alias("n"), *said, every("calls"), every("asked"), F.min("bad").alias("bad")))


def known_before(facts: DataFrame, states: DataFrame | None, calls: DataFrame | None) -> DataFrame:
    """For each range what holds at its start: first_sequence, cwd, branch, head, session, known (calls that it asks for), stop.

    states(path, source_generation, next_sequence, state) and calls(path,
    source_generation, call_id) are what earlier batches left; they don't hold
    for a file that is read from its start again.
    """
    spark = facts.sparkSession
    if states is None:
        states = spark.createDataFrame([], "path string, source_generation string, next_sequence bigint, state string")
    if calls is None:
        calls = spark.createDataFrame([], "path string, source_generation string, call_id string")
    files = facts.groupBy(*FILE).agg(F.min("first").alias("begin"), F.min("bad").alias("bad"))
    told = lambda c: F.get_json_object("state", f"$.{c}").alias(f"old_{c}")
    old = states.select("path", F.col("source_generation").alias("generation"), "next_sequence", *map(told, LAST), F.get_json_object("state", "$.stopped").cast("bigint").alias("old_stop"))
    begun = files.join(old, FILE, "left")
    anew = F.col("begin") == 0
    begun = begun.select(*FILE, "bad", anew.alias("anew"), F.when(anew, F.lit(0)).otherwise(F.coalesce("next_sequence", F.lit(0))).cast("long").alias("base"), *(F.when(~anew, F.col(f"old_{c}")).alias(f"old_{c}") for c in LAST), F.when(~anew, F.col("old_stop")).alias("old_stop"))
    w = Window.partitionBy(*FILE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    scanned = facts.select(*RANGE, "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), *(F.last(c, ignorenulls=True).over(w).alias(f"{c}_before") for c in LAST), *LAST)
    scanned = scanned.join(begun, FILE)
    asked = facts.select(*RANGE, F.explode("asked").alias("call_id"))
    made = facts.select(*FILE, F.explode("calls").alias("call_id"), F.col("range").alias("made")).groupBy(*FILE, "call_id").agg(F.min("made").alias("made"))
    here = asked.join(made, [*FILE, "call_id"]).where("made < range").select(*RANGE, "call_id")
    older = calls.select("path", F.col("source_generation").alias("generation"), "call_id").distinct().join(begun.where("not anew").select(*FILE), FILE, "left_semi")
    there = asked.join(older, [*FILE, "call_id"]).select(*RANGE, "call_id")
    known = here.unionByName(there).groupBy(*RANGE).agg(F.collect_set("call_id").alias("known"))
    out = scanned.join(known, RANGE, "left")
    return out.select(*RANGE, (F.col("base") + F.col("before")).alias("first_sequence"), *(F.coalesce(f"{c}_before", f"old_{c}").alias(c) for c in LAST), F.coalesce("known", F.array().cast("array<string>")).alias("known"), F.least("bad", "old_stop").alias("stop"), (F.col("base") + F.col("before") + F.col("n")).alias("next_sequence"), *(F.coalesce(c, f"{c}_before", f"old_{c}").alias(f"{c}_after") for c in LAST))


def parse_lines(lines: DataFrame, family: str, surface: str = "cli", fallback: str = "1970-01-01T00:00:00+00:00", states: DataFrame | None = None, calls: DataFrame | None = None, chunk: int = tail.CHUNK) -> DataFrame:
    """Records of tailed lines(path, generation, source_offset, value), a task for each range of a file.

    What an earlier line of a file says (workspace, session, calls) holds for the
    later ones. So a first pass takes from each range what later ones need, a scan
    over the ranges adds it up, and a second pass parses every range by itself. The last rows
    have no record but what is known after each file. A file that can't be read on
    becomes an issue at the line where that shows, and is stopped there for good,
    until it is replaced.
    """
    parser = PARSERS[family]

    def run(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        at = known.iloc[0]
        text = lambda c: at[c] if isinstance(at[c], str) else None
        frame = frame.sort_values("source_offset")
        source = rec.Source(frame["path"].iloc[0], family, frame["generation"].iloc[0], surface, fallback_timestamp=fallback)
        rows, more = [], {}
        if family == "codex":
            more = {"state": rec.RolloutState.told(*map(text, LAST), at["known"])}
        elif family == "grok":
            more = {"cwd": rec.grok_workspace(source.path)}
        sequence, stop = int(at["first_sequence"]), None if pd.isna(at["stop"]) else int(at["stop"])
        for offset, value in zip(frame["source_offset"], frame["value"], strict=True):
            line = bytes(value)
            if stop is not None and offset > stop:
                break
            try:
                found = parser(line, source, int(offset), sequence, **more)
            except ValueError:
                found = [rec.Record(int(offset), line, issue="file_malformed")]
            for r in found:
                called = r.event["payload"].get("call_id") if r.event is not None and r.event["kind"] == "tool_call" else None
                rows.append((source.path, source.generation, r.offset, r.raw, rec.raw_object_id(source, r), "sha256:" + sha256(r.raw), r.issue, None if r.event is None else json.dumps(r.event), called if isinstance(called, str) else None, None, None, r.sensitive))
            # Rollouts count lines; the other tools count their events.
            sequence += 1 if family == "codex" else sum(r.event is not None for r in found)
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PARSED.split(", ")])

    before = settled(known_before(range_facts(lines, family, chunk), states, calls))
    dealt = lines.select(*FILE, "source_offset", "value", F.floor(F.col("source_offset") / chunk).alias("range"))
    parsed = dealt.groupBy(*RANGE).cogroup(before.groupBy(*RANGE)).applyInPandas(run, PARSED)
    after = F.to_json(F.struct(*(F.col(f"last.{c}_after").alias(c) for c in LAST), F.col("stop").alias("stopped")))
    ends = before.groupBy(*FILE).agg(F.max_by(F.struct("next_sequence", *(f"{c}_after" for c in LAST)), "range").alias("last"), F.min("stop").alias("stop"))
    none = {c.split(" ")[0]: F.lit(None).cast(c.split(" ")[1]) for c in PARSED.split(", ")}
    filled = none | {"path": F.col("path"), "source_generation": F.col("generation"), "next_sequence": F.col("last.next_sequence"), "state": after}
    return parsed.unionByName(ends.select(*(v.alias(k) for k, v in filled.items())))


def event_rows(parsed: DataFrame, collector: str | None = None) -> DataFrame:
    """The events of parsed records as rows of the store, ingestion ids left to the store."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in FLAT.split(", ")]
        for frame in batches:
            rows = []
            for raw, text in zip(frame["raw_object_id"], frame["event"], strict=True):
                e = json.loads(text)
                w, p, t = e["workspace"] or {}, e["provenance"], e["tool"]
                shown = e["payload"].get("text")
                rows.append((e["event_id"], e["native_session_id"], e["sequence"], e["kind"], t["family"], t["surface"], t["profile"], w.get("cwd"), w.get("branch"), w.get("head"), e["timestamp"], e["timestamp_precision"], p["source_path"], p["source_generation"], p["source_offset"], p["ingestion_sequence"], p["ordering_confidence"], canonical_json(sorted_keys(e["payload"])), shown if isinstance(shown, str) else None, len(canonical_json(e).encode()), raw))
            yield pd.DataFrame(rows, columns=names)

    flat = parsed.where("event is not null").select("raw_object_id", "event").mapInPandas(run, FLAT)
    return with_times(flat).withColumns({"origin_collector_id": F.lit(collector).cast("string"), "ingestion_id": F.lit(None).cast("long")})


FLAT = ", ".join(c for c in EVENTS.split(", ") if c.split(" ")[0] not in ("ts_seconds", "ts_nanos", "origin_collector_id", "ingestion_id"))


def raw_rows(parsed: DataFrame, stored_at: int = 0) -> DataFrame:
    found = parsed.where("raw is not null")
    return found.select("raw_object_id", F.col("path").alias("source_path"), "source_generation", "source_offset", "blob_hash", F.col("raw").alias("bytes"), F.lit(rec.ADAPTER_VERSION).alias("parser_version"), F.lit(stored_at).cast("long").alias("stored_at"))


def state_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("next_sequence is not null").select("path", "source_generation", "next_sequence", "state")


def call_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("call_id is not null").select("path", "source_generation", "call_id").distinct()


def put_lines(store: Store, lines: DataFrame, family: str, batch: int | None, stream: str) -> int:
    """Parses tailed lines, as a continuation of what the store knows of their files, and adds them as one batch; how many events were new."""
    paths = lines.select("path").distinct()
    parsed = parse_lines(lines, family, states=store.states(paths), calls=store.calls(paths) if family == "codex" else None).persist()
    try:
        return store.commit(batch, event_rows(parsed), raw_rows(parsed), state_rows(parsed), stream, calls=call_rows(parsed))
    finally:
        parsed.unpersist()


def ingest(spark: SparkSession, pattern: str, family: str, store: Store, checkpoint: str, once: bool = True, batch_bytes: int = BATCH_BYTES) -> StreamingQuery:
    """Tails files into the store, at most about ``batch_bytes`` a batch; with ``once``, until there is nothing more to read.

    The stream is known by family, pattern and checkpoint: its batches never meet those of another one.
    Continue's documents and OpenCode's database (its pattern is a path) change in place; only what is new of them becomes events.
    """
    if family == "continue":
        return ingest_documents(spark, pattern, store, checkpoint, once, batch_bytes)
    if family == "opencode":
        return ingest_database(spark, pattern, store, checkpoint, once)
    tail.register(spark)
    stream = f"{family}:{sha256(canonical_json([pattern, checkpoint]))[:16]}"
    lines = spark.readStream.format("jsonl_tail").options(path=pattern, batch_bytes=batch_bytes, checkpoint=checkpoint).load()
    writer = lines.writeStream.foreachBatch(lambda batch, n: put_lines(store, batch, family, n, stream)).option("checkpointLocation", checkpoint)
    return caught_up(writer) if once else writer.trigger(processingTime=f"{SCAN_SECONDS} seconds").start()


def _parsed(rows: DataFrame, records) -> DataFrame:
    """PARSED rows of whole records: records(row) gives a source and its records, or raises ValueError."""
    names = [c.split(" ")[0] for c in PARSED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                source, found = records(row)
                out += [(source.path, source.generation, r.offset, r.raw, rec.raw_object_id(source, r), "sha256:" + sha256(r.raw), r.issue, None if r.event is None else json.dumps(r.event), None, None, None, r.sensitive) for r in found]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, PARSED)


def _document(row: dict) -> tuple[rec.Source, list[rec.Record]]:
    source, data = rec.Source(row["path"], "continue", row["generation"]), bytes(row["value"])
    try:
        return source, rec.parse_continue(data, source)
    except (ValueError, AttributeError):
        return source, [rec.Record(0, data, issue="file_malformed")]


def _part(row: dict) -> tuple[rec.Source, list[rec.Record]]:
    source = rec.Source(row["path"], "opencode", row["generation"])
    return source, rec.parse_opencode([{k: None if isinstance(v, float) else v for k, v in row.items()}], source)


def _ingested(spark: SparkSession, kind: str, options: dict, records, store: Store, stream: str, checkpoint: str, once: bool) -> StreamingQuery:
    snapshots.register(spark)
    rows = spark.readStream.format(kind).options(**options, checkpoint=checkpoint).load()

    def put(batch: DataFrame, batch_id: int) -> None:
        parsed = _parsed(batch, records).persist()
        try:
            store.commit(batch_id, event_rows(parsed), raw_rows(parsed), stream=stream)
        finally:
            parsed.unpersist()

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return caught_up(writer) if once else writer.trigger(processingTime=f"{SCAN_SECONDS} seconds").start()


def ingest_documents(spark: SparkSession, pattern: str, store: Store, checkpoint: str, once: bool = True, batch_bytes: int = BATCH_BYTES) -> StreamingQuery:
    """JSON documents that are rewritten in place; messages that were there before are known by their place and text."""
    stream = f"continue:{sha256(canonical_json([pattern, checkpoint]))[:16]}"
    return _ingested(spark, "json_snapshots", {"path": pattern, "batch_bytes": batch_bytes}, _document, store, stream, checkpoint, once)


def ingest_database(spark: SparkSession, path: str, store: Store, checkpoint: str, once: bool = True, batch_pages: int = snapshots.BATCH_PAGES) -> StreamingQuery:
    """Text parts of a database; a session with news is read whole, so that ranks are right."""
    stream = f"opencode:{sha256(canonical_json([path, checkpoint]))[:16]}"
    return _ingested(spark, "opencode_parts", {"path": path, "batch_pages": batch_pages}, _part, store, stream, checkpoint, once)


def caught_up(writer) -> StreamingQuery:
    """Runs a bounded stream batch by batch until its source has nothing more, and ends it."""
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def replay(store: Store, after: str | None = None, limit: int = PAGE) -> tuple[DataFrame, int]:
    """A page of stored events behind a cursor, in order, up to a bound; later ones have greater ingestion ids."""
    from threadlake.operators.timeline import events_page

    upto = store.watermark()
    return events_page(store.events(), after=after, limit=limit, upto=upto), upto


def replay_all(store: Store, limit: int = PAGE) -> Iterator[list]:
    """All stored events up to the bound, page by page."""
    upto, after = store.watermark(), None
    from threadlake.operators.timeline import events_page

    while rows := events_page(store.events(), after=after, limit=limit, upto=upto).collect():
        yield rows
        after = rows[-1]["event_id"]


def follow(store: Store, after: str | None = None, limit: int = PAGE) -> Iterator[list]:
    """Pages of stored events in order of ingestion, behind an event, until the last commit; to go on, give the last event's id.

    Every commit's part is read once, a few commits at a time; those before the event are left alone.
    """
    done = 0
    if after is not None:
        row = store.events().where(F.col("event_id") == after).select("ingestion_id").first()
        if row is None:
            raise ValueError(f"unknown event {after}")
        done = row["ingestion_id"]
    ahead, page = [c for c in store.commits() if c.counts.get("events") and c.top > done], []
    while ahead:
        some = [ahead.pop(0)]
        while ahead and sum(c.counts["events"] for c in some) < 64 * limit:
            some.append(ahead.pop(0))
        for row in store.events_of(some).where(F.col("ingestion_id") > done).orderBy("ingestion_id").toLocalIterator():
            page.append(row)
            if len(page) == limit:
                yield page
                page = []
    if page:
        yield page


def event_stream(store: Store, checkpoint: str, put: Callable[[DataFrame, int], None], once: bool = False, most_commits: int = 64) -> StreamingQuery:
    """Gives each batch of new events to ``put``, as commits come; the checkpoint remembers which were given."""
    from threadlake.streaming.reconcile import commit_rows

    def run(batch: DataFrame, batch_id: int) -> None:
        numbers = {r["number"] for r in batch.where("number is not null and counts['events'] > 0").select("number").collect()}
        put(store.events_of([c for c in store.commits() if c.number in numbers]), batch_id)

    writer = commit_rows(store, most_commits).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{SCAN_SECONDS} seconds")).start()


def live_events(store: Store, after: int) -> tuple[DataFrame, int]:
    """What was ingested behind the bound, and the next bound; a reader that lags just asks later."""
    upto = store.watermark()
    return store.events().where((F.col("ingestion_id") > after) & (F.col("ingestion_id") <= upto)), upto


def ingest_batch(store: Store, collectors: wire.Collectors, bucket: wire.TokenBucket, token: str, body: str, at: str, now: float) -> int:
    """A collector's batch: authenticated, within its rate, checked, stored with its cursor, and noted either way.

    How many events were new. wire.BatchError says why a batch is refused.
    """
    size, collector, count = len(body.encode()), collectors.authenticate(token), 0
    try:
        if collector is None:
            raise wire.BatchError("unknown collector")
        if not bucket.allow(collector, now):
            raise wire.BatchError("too many requests")
        batch = wire.decode(body)
        count = len(batch["events"])
        source = wire.scoped(collector, batch["source_id"])
        spark, cursor = store.spark, batch["cursor"]
        raws = [(r["id"], r.get("source_path", source), r["generation"], r["offset"], "sha256:" + sha256(r["bytes"]), r["bytes"], rec.ADAPTER_VERSION, 0) for r in batch["raw_objects"]]
        by_place = {(r["generation"], r["offset"]): r["id"] for r in batch["raw_objects"]}
        parsed = spark.createDataFrame([(by_place.get((e["provenance"]["source_generation"], e["provenance"]["source_offset"])), json.dumps(e)) for e in batch["events"]], "raw_object_id string, event string")
        known = spark.createDataFrame([(source, collector, cursor.get("source_generation"), cursor.get("byte_offset"), cursor.get("next_sequence"), at)], CURSORS)
        stored = store.commit(None, event_rows(parsed, collector), spark.createDataFrame(raws, RAWS), stream=source, cursors=known)
    except wire.BatchError as e:
        store.audit(at, collector, size, count, str(e))
        raise
    store.audit(at, collector, size, count, "accepted")
    return stored


def ingest_cursor(store: Store, collectors: wire.Collectors, token: str, source_id: str) -> dict | None:
    """Where a collector's source goes on."""
    collector = collectors.authenticate(token)
    if collector is None:
        raise wire.BatchError("unknown collector")
    return store.cursor(wire.scoped(collector, source_id))


def quiet_paths(notices: DataFrame, now: float, debounce: float) -> DataFrame:
    """Paths whose last notice lies a quiet period back, in order."""
    return notices.groupBy("path").agg(F.max("at").alias("last")).where(F.lit(now) - F.col("last") >= debounce).select("path").orderBy("path")


class RateLimit(StatefulProcessor):
    """A token bucket for each collector: rows(collector, at) to (collector, at, allowed)."""

    per_minute = 60

    def init(self, handle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        tokens, last = self.bucket.get() if self.bucket.exists() else (float(self.per_minute), None)
        out = []
        for frame in rows:
            for at in sorted(frame["at"]):
                if last is not None:
                    tokens = min(float(self.per_minute), tokens + (at - last) * self.per_minute / 60)
                last = at
                allowed = tokens >= 1
                tokens -= allowed
                out.append((key[0], at, allowed))
        self.bucket.update((tokens, last))
        yield pd.DataFrame(out, columns=["collector", "at", "allowed"])

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame) -> DataFrame:
    """Whether each streamed request is within its collector's rate."""
    return requests.groupBy("collector").transformWithStateInPandas(RateLimit(), "collector string, at double, allowed boolean", "Append", "None")
