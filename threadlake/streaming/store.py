"""An append-only store in Parquet: batches of streams, atomic, idempotent and numbered for good.

A commit is one file ``commits/<number>.json``, written under another name and
renamed only if the number is free. It names what belongs to it: for each table a folder ``<table>/part=<name>``
that was written before. What no commit names is not there, so a batch's tables
appear together, a failed attempt leaves nothing behind, and of two writers that
take the same number one starts anew. A number whose file can't be read is taken
and means nothing. A batch is known by its stream and its
number there: a retried one changes nothing, and streams don't meet.

A commit says of each generation (of states: of each path) which offsets its part
holds, so that a batch is compared with the parts that may hold the same, not with all. Of every
CHECKPOINT commits the list up to there is written once more in one file; a reader
takes that and the commits behind it, one that stays open only what is new.

Ingestion ids are a commit's ``base`` plus the row's place in it, without gaps. The base goes on
from the last commit's, whatever is removed later, so no id comes twice. What
holds now is a view over what was appended.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import chronology as ch
from threadlake.functions.text import title_candidate
from threadlake.operators.correlation import AUDIT, refuse_ruled_out
from threadlake.operators.retention import MaintenanceReport, collectable_blobs, kept_raws, keep_conversation, latest_per_group, legacy_envelopes, orphans
from threadlake.schema import DISPOSABLE

EVENTS = (
    "event_id string, native_session_id string, sequence bigint, kind string, tool_family string, surface string, profile string, cwd string, branch string, head string, timestamp string, timestamp_precision string, "
    "ts_seconds bigint, ts_nanos int, source_path string, source_generation string, source_offset bigint, ingestion_sequence bigint, ordering_confidence double, payload_json string, text string, canonical_bytes bigint, "
    "raw_object_id string, origin_collector_id string, ingestion_id bigint"
)
RAWS = "raw_object_id string, source_path string, source_generation string, source_offset bigint, blob_hash string, bytes binary, parser_version string, stored_at bigint"
#: What a file's earlier lines say about later ones: state as JSON, and the next sequence.
STATES = "path string, source_generation string, next_sequence bigint, state string"
CURSORS = "source_id string, collector_id string, source_generation string, byte_offset bigint, next_sequence bigint, updated_at string"
AUDITS = "at string, collector_id string, byte_size bigint, event_count bigint, outcome string"
BLOBS = "blob_hash string, bytes binary, stored_at bigint"
HANDOFFS = "global_id string, handoff_id string, snapshot_id string, created_at string, document string"
SNAPSHOTS = "snapshot_id string, document string"
REMOVED = "event_id string, source_generation string"
GONE = "blob_hash string"
SUMMARIES = "native_session_id string, family string, cwd string, objective string, terms array<string>, started_at bigint, ended_at bigint, origin string"
CANDIDATES = "candidate_id string, left_id string, right_id string, score double, status string, evidence array<string>"
GLOBALS = "global_id string, objective string, created_at string, updated_at string"
#: Calls that a file's earlier lines made, each once, so that what a batch writes doesn't grow with its file.
CALLS = "path string, source_generation string, call_id string"
#: What a commit changes in its sessions' statistics; a removal's are negative and offer no title.
DELTAS = "native_session_id string, event_count bigint, content_bytes bigint, title string, priority int, sequence bigint, event_id string"
POSTINGS = "token string, event_id string, places array<int>, bucket int"
TABLES = {"deltas": DELTAS, "postings": POSTINGS, "calls": CALLS, "summaries": SUMMARIES, "decisions": AUDIT, "candidates": CANDIDATES, "globals": GLOBALS, "events": EVENTS, "raws": RAWS, "states": STATES, "cursors": CURSORS, "audits": AUDITS, "blobs": BLOBS, "handoffs": HANDOFFS, "snapshots": SNAPSHOTS, "removed": REMOVED, "removed_blobs": GONE}
#: Generations (or paths) that a commit lists; a part with more is always read.
FEW = 1000
#: Commits after which their list is written in one file.
CHECKPOINT = 64
#: Columns that place a table's rows: what they belong to, and where in it they stand.
PLACED = {"events": ("source_generation", "source_offset"), "raws": ("source_generation", "source_offset"), "removed": ("source_generation", None), "states": ("path", None), "calls": ("path", None)}
LOCAL_BITS, ANYWHERE = 33, 1 << 62

Spans = Mapping[str, list[int]]


class ImmutableConflict(ValueError):
    """A raw record that differs from the one stored under its name."""


@dataclass
class Commit:
    """What one batch of a stream added.

    spans: by table, of each generation or path the least and greatest offset in the
    part; null if there are too many. starts: of each partition of the events'
    part the number of its first row; null if their ids are whole.
    """

    number: int
    stream: str
    batch: int
    base: int
    top: int
    revision: int
    parts: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    spans: dict[str, dict[str, list[int]] | None] = field(default_factory=dict)
    starts: dict[str, int] | None = None
    #: Index segments that this commit's segment stands for.
    replaces: list[str] = field(default_factory=list)
    #: Ingestion ids that this commit was derived from, each behind the first number and up to the second.
    ranges: list[list[int]] = field(default_factory=list)

    @classmethod
    def loaded(cls, text: str) -> Commit | None:
        """A commit from its file's text, None if that is torn."""
        try:
            value = json.loads(text)
            return cls(**{f.name: value[f.name] for f in fields(cls) if f.name in value})
        except (ValueError, TypeError, KeyError):
            return None

    def touches(self, name: str, wanted: Spans | None) -> bool:
        """Whether the part of a table may hold rows at the wanted places."""
        own = self.spans.get(name)
        if wanted is None or own is None:
            return True
        return any(k in own and own[k][0] <= hi and lo <= own[k][1] for k, (lo, hi) in wanted.items())


class Files:
    """Small files of a folder in any store that Spark reaches, by Hadoop's client."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.folder = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.folder.getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"
        self.gateway = spark.sparkContext._gateway

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def _local(self, name: str) -> str:
        return os.path.join(self.folder.toUri().getPath(), name)

    def make(self) -> None:
        """The folder, if it isn't there."""
        self.fs.mkdirs(self.folder)

    def there(self, name: str) -> bool:
        return os.path.exists(self._local(name)) if self.local else self.fs.exists(self._at(name))

    def read(self, name: str) -> str | None:
        """A file's text, None if there is none."""
        if not self.there(name):
            return None
        if self.local:
            with open(self._local(name), encoding="utf-8", errors="replace") as f:
                return f.read()
        source = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def write(self, name: str, text: str, replace: bool = False) -> bool:
        """Puts a whole file in place; whether its name was free, unless it replaces what is there."""
        waiting = f".{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self._local(""), exist_ok=True)
            with open(self._local(waiting), "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                if replace:
                    os.replace(self._local(waiting), self._local(name))
                else:
                    os.link(self._local(waiting), self._local(name))  # fails if the name is taken
            except FileExistsError:
                return False
            finally:
                if os.path.exists(self._local(waiting)):
                    os.unlink(self._local(waiting))
            return True
        out = self.fs.create(self._at(waiting), True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if replace else rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._at(waiting), self._at(name), how)
        except Py4JJavaError as e:
            self.fs.delete(self._at(waiting), False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True


def name_of(number: int) -> str:
    return f"{number:012}.json"


@dataclass
class Store:
    """A store below a folder that all machines share."""

    spark: SparkSession
    path: str
    conversation_only: bool = True

    def __post_init__(self) -> None:
        self._files: Files | None = None
        self._known: list[Commit] = []
        self._next = 0

    def commits(self) -> list[Commit]:
        """All readable commits in order; those that were read before aren't read again."""
        files = self._files = self._files or Files(self.spark, f"{self.path}/commits")
        if not self._next and (last := files.read("last")) is not None and last.isdigit():
            lines = (files.read(f"upto-{last}.jsonl") or "").splitlines()
            listed = [Commit.loaded(line) for line in lines]
            if listed and None not in listed:
                self._known, self._next = listed, int(last) + 1
        while (text := files.read(name_of(self._next))) is not None:
            commit = Commit.loaded(text)
            if commit is not None:
                self._known.append(commit)
            self._next += 1
        return list(self._known)

    def _put(self, commit: Commit) -> bool:
        """Whether the commit could take its number."""
        self.commits()
        if not self._files.write(name_of(commit.number), json.dumps(commit.__dict__)):
            return False
        if commit.number % CHECKPOINT == CHECKPOINT - 1:
            known = [c for c in self.commits() if c.number <= commit.number]
            self._files.write(f"upto-{commit.number}.jsonl", "\n".join(json.dumps(c.__dict__) for c in known))
            self._files.write("last", str(commit.number), replace=True)
        return True

    def _read(self, name: str, commits: list[Commit], wanted: Spans | None = None) -> DataFrame:
        """A table's rows with the number of their commit, of the parts that may hold wanted ones; its schema without rows if there are none."""
        there = [c for c in commits if c.counts.get(name) and c.touches(name, wanted)]
        schema = TABLES[name] + ", number long"
        if not there:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(TABLES[name] + ", part string").option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/{c.parts[name]}" for c in there))
        named = self.spark.createDataFrame([(c.parts[name].removeprefix("part="), c.number, c.base, None if c.starts is None else {int(k): v for k, v in c.starts.items()}) for c in there], "part string, number long, base long, starts map<long,long>")
        joined = rows.join(F.broadcast(named), "part")
        if name == "events":
            local = F.col("starts")[F.shiftright("ingestion_id", LOCAL_BITS)] + F.col("ingestion_id").bitwiseAND((1 << LOCAL_BITS) - 1) + 1
            joined = joined.withColumn("ingestion_id", F.when(F.col("starts").isNull(), F.col("ingestion_id")).otherwise(F.col("base") + local))
        return joined.drop("part", "base", "starts").select(*(c.split(" ")[0] for c in TABLES[name].split(", ")), "number")

    def _add(self, commit: Commit, name: str, frame: DataFrame, whole_ids: bool = False) -> None:
        """Writes a part of a table and notes in the commit what it holds."""
        commit.parts[name] = f"part=p{uuid.uuid4().hex}"
        at = f"{self.path}/{name}/{commit.parts[name]}"
        names = [c.split(" ")[0] for c in TABLES[name].split(", ")]
        if name == "events" and not whole_ids:
            # In order within the batch: a range a partition, without one task for all. The numbers are made dense when they are read.
            frame = frame.repartitionByRange("source_path", "source_offset", "event_id").sortWithinPartitions("source_path", "source_offset", "event_id").withColumn("ingestion_id", F.monotonically_increasing_id())
        if name == "postings":
            frame.select(*names).repartition("bucket").sortWithinPartitions("token").write.partitionBy("bucket").parquet(at)
        else:
            frame.select(*names).write.parquet(at)
        written = self.spark.read.schema(TABLES[name]).parquet(at)
        if name == "events" and not whole_ids:
            commit.starts, n = {}, 0
            for r in written.groupBy(F.shiftright("ingestion_id", LOCAL_BITS).alias("p")).count().orderBy("p").collect():
                commit.starts[str(r["p"])] = n
                n += r["count"]
            commit.counts[name] = n
            commit.top += n
        else:
            commit.counts[name] = written.count()
        if name in PLACED:
            commit.spans[name] = places(written, *PLACED[name])

    def table(self, name: str) -> DataFrame:
        """What a table holds now."""
        commits = self.commits()
        rows = self._read(name, commits)
        if name == "events":
            rows = rows.join(self._read("removed", commits).select("event_id").distinct(), "event_id", "left_anti")
        elif name == "blobs":
            gone = self._read("removed_blobs", commits).groupBy("blob_hash").agg(F.max("number").alias("at"))
            rows = rows.join(gone, "blob_hash", "left").where("at is null or number > at").drop("at")
        return rows.drop("number").select(*(c.split(" ")[0] for c in TABLES[name].split(", ")))

    def events(self) -> DataFrame:
        return self.table("events")

    def events_of(self, commits: list[Commit]) -> DataFrame:
        """The events of some commits that are still there."""
        gone = self._read("removed", self.commits()).select("event_id").distinct()
        return self._read("events", commits).drop("number").join(gone, "event_id", "left_anti")

    def transact(self, stream: str, batch: int | None, make, revise: bool = False, replaces: list[str] | None = None, ranges: list[tuple[int, int]] | None = None) -> Commit:
        """Adds ``make(commits)``, a frame for each of some tables, as one batch of a stream.

        A function in place of a frame makes it from the commit as it is by then, with the parts before it written.

        batch None: the stream's next one. A batch that is known is left as it was.
        If another writer was faster, everything is made anew on top of its commit.
        """
        while True:
            commits = self.commits()
            known = next((c for c in commits if c.stream == stream and c.batch == batch), None)
            if known is not None:
                return known
            last = commits[-1] if commits else Commit(-1, "", -1, 0, 0, 0)
            number = batch if batch is not None else max((c.batch for c in commits if c.stream == stream), default=-1) + 1
            commit = Commit(self._next, stream, number, last.top, last.top, last.revision + revise, replaces=replaces or [], ranges=[list(r) for r in ranges or ()])
            for name, frame in make(commits).items():
                self._add(commit, name, frame(commit) if callable(frame) else frame)
            if self._put(commit):
                return commit

    def commit(self, batch: int, events: DataFrame, raws: DataFrame | None = None, states: DataFrame | None = None, stream: str = "", cursors: DataFrame | None = None, calls: DataFrame | None = None) -> int:
        """Stores a batch's new events, raws, file states and cursors together; how many events were new.

        An event's identity is known for ever, so repeats vanish however late they
        come, and what was removed stays removed. Under conversation-only retention
        disposable events are left out, and with them the raws that nothing else needs.
        """
        once = events.groupBy("event_id").agg(F.min(F.struct(*(c for c in events.columns if c != "event_id"))).alias("e")).select("event_id", "e.*")
        wanted = places(once, *PLACED["events"])

        def make(commits: list[Commit]) -> dict[str, DataFrame]:
            kept = keep_conversation(once) if self.conversation_only else once
            known = self._read("events", commits, wanted).select("event_id").unionByName(self._read("removed", commits, wanted).select("event_id"))
            out = {"events": kept.join(known, "event_id", "left_anti"), "deltas": lambda commit: deltas(self._read("events", [commit]))}
            if raws is not None:
                out["raws"] = self._fresh_raws(kept_raws(raws, events) if self.conversation_only else raws, commits)
            if states is not None:
                out["states"] = states
            if calls is not None:
                out["calls"] = calls
            if cursors is not None:
                out["cursors"] = cursors
            return out

        return self.transact(stream, batch, make).counts["events"]

    def _fresh_raws(self, raws: DataFrame, commits: list[Commit]) -> DataFrame:
        known = self._read("raws", commits, places(raws, *PLACED["raws"])).select("raw_object_id", F.col("blob_hash").alias("known_hash")).distinct()
        grouped = raws.groupBy("raw_object_id").agg(F.min("blob_hash").alias("least"), F.max("blob_hash").alias("most"))
        if grouped.join(known, "raw_object_id", "left").where("least <> most or known_hash <> least").limit(1).count():
            raise ImmutableConflict("a stored raw record would change")
        once = raws.groupBy("raw_object_id").agg(F.min(F.struct(*(c for c in raws.columns if c != "raw_object_id"))).alias("r")).select("raw_object_id", "r.*")
        return once.join(known, "raw_object_id", "left_anti")

    def watermark(self) -> int:
        """The greatest ingestion id that was ever given."""
        return max((c.top for c in self.commits()), default=0)

    def revision(self) -> int:
        """Goes up when what was derived from events must be built anew."""
        return max((c.revision for c in self.commits()), default=0)

    def bump_revision(self) -> int:
        return self.transact("revision", None, lambda _: {}, revise=True).revision

    def states(self, paths: DataFrame | None = None) -> DataFrame:
        """The last state of each file and generation (of some paths), from the last parts that say something of them."""
        commits = [c for c in self.commits() if c.counts.get("states")]
        wanted = None if paths is None else places(paths, "path", None)
        if wanted is not None:
            last = {path: c.number for c in commits for path in c.spans.get("states") or () if path in wanted}
            commits = [c for c in commits if c.spans.get("states") is None or c.number in last.values()]
        rows = self._read("states", commits)
        if wanted is not None:
            rows = rows.where(F.col("path").isin(list(wanted)))
        return rows.groupBy("path", "source_generation").agg(F.max_by(F.struct("next_sequence", "state"), "number").alias("s")).select("path", "source_generation", "s.*")

    def calls(self, paths: DataFrame) -> DataFrame:
        """The calls that files of some paths made so far."""
        wanted = places(paths, "path", None)
        rows = self._read("calls", self.commits(), wanted).drop("number")
        return rows if wanted is None else rows.where(F.col("path").isin(list(wanted)))

    def cursor(self, source_id: str) -> dict | None:
        """The last cursor of a source."""
        row = self._read("cursors", self.commits()).where(F.col("source_id") == source_id).orderBy(F.col("number").desc()).drop("number").first()
        return None if row is None else row.asDict()

    def audit(self, at: str, collector: str | None, size: int, count: int, outcome: str) -> None:
        """Notes one try to ingest, whatever came of it."""
        row = self.spark.createDataFrame([(at, collector, size, count, outcome)], AUDITS)
        self.transact("audit", None, lambda _: {"audits": row})

    # Handoffs and their snapshots are named by their content: the same again changes nothing.

    def fresh_handoffs(self, rows: DataFrame, commits: list[Commit]) -> dict[str, DataFrame]:
        """Of handoffs(global_id, handoff_id, snapshot_id, created_at, document) what isn't there yet, as two tables."""
        fresh = rows.dropDuplicates(["handoff_id"]).join(self._read("handoffs", commits).select("handoff_id"), "handoff_id", "left_anti")
        shots = rows.select("snapshot_id", "document").dropDuplicates(["snapshot_id"]).join(self._read("snapshots", commits).select("snapshot_id"), "snapshot_id", "left_anti")
        return {"handoffs": fresh, "snapshots": shots}

    def store_handoffs(self, rows: DataFrame) -> int:
        """Adds handoffs that aren't there; how many."""
        return self.transact("handoffs", None, lambda commits: self.fresh_handoffs(rows, commits)).counts["handoffs"]

    # What reconciling adds: the last row of a session or candidate holds; a global session's times move on.

    def _last(self, name: str, key: str) -> DataFrame:
        rows = self._read(name, self.commits())
        return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "number"))), "number").alias("x")).select(key, "x.*")

    def summaries(self) -> DataFrame:
        return self._last("summaries", "native_session_id")

    def candidates(self) -> DataFrame:
        return self._last("candidates", "candidate_id")

    def globals(self, more: DataFrame | None = None) -> DataFrame:
        """Global sessions with their first objective and latest update; with rows that are about to be added."""
        rows = self.table("globals")
        rows = rows if more is None else rows.unionByName(more)
        return rows.groupBy("global_id").agg(F.min_by("objective", "created_at").alias("objective"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))

    def decide(self, action: str, global_id: str, native_session_id: str, actor: str, at: str, confidence: float = 1.0, version: str = "manual-v1", reason: str = "") -> None:
        """Adds a user's decision; RejectedMembership for a link that is ruled out."""

        def make(_: list[Commit]) -> dict[str, DataFrame]:
            refuse_ruled_out(self.table("decisions"), action, global_id, native_session_id)
            return {"decisions": self.spark.createDataFrame([(self.next_number(), action, global_id, native_session_id, confidence, version, actor, reason, at)], AUDIT)}

        self.transact("decisions", None, make)

    def next_number(self) -> int:
        """The number that the next commit will have, unless another writer is faster; it orders decisions."""
        return self._next

    # Blobs by the hash of their bytes.

    def put_blobs(self, blobs: DataFrame, now: int) -> int:
        """Adds blobs(bytes) under their hashes; how many are new."""
        named = blobs.select(F.concat(F.lit("sha256:"), F.sha2("bytes", 256)).alias("blob_hash"), "bytes", F.lit(now).cast("long").alias("stored_at")).dropDuplicates(["blob_hash"])
        there = self.table("blobs").select("blob_hash")
        return self.transact("blobs", None, lambda _: {"blobs": named.join(there, "blob_hash", "left_anti")}).counts["blobs"]

    def get_blob(self, blob_hash: str) -> bytes | None:
        """A blob's bytes, if they are what the hash says."""
        row = self.table("blobs").where(F.col("blob_hash") == blob_hash).where(F.concat(F.lit("sha256:"), F.sha2("bytes", 256)) == F.col("blob_hash")).select("bytes").first()
        return None if row is None else bytes(row["bytes"])

    def collect_blobs(self, queued: DataFrame, now: int) -> int:
        """Drops blobs that nothing refers to and that are queued or old; how many."""
        gone = collectable_blobs(self.table("blobs"), self.table("raws"), queued, now).select("blob_hash")
        return self.transact("blobs", None, lambda _: {"removed_blobs": gone}).counts["removed_blobs"]

    def remove_events(self, ids: DataFrame) -> int:
        """Removes events(event_id) for good: they don't come back when their files are read again.

        Statistics are views and follow by themselves; handoffs made from the events
        are stale, which the raised revision says.
        """
        there = self.events().join(ids.select("event_id").distinct(), "event_id", "left_semi")
        return self.transact("removed", None, lambda _: {"removed": there.select("event_id", "source_generation"), "deltas": deltas(there, -1)}, revise=True).counts["removed"]

    def statistics(self) -> DataFrame:
        """Each session's events, bytes and title, from what commits changed, without a look at the events.

        After a removal a title stays as it was, though its event may be gone, until ``rebuild_statistics``.
        """
        commits = self.commits()
        gone = {name for c in commits for name in c.replaces}
        rows = self._read("deltas", [c for c in commits if c.parts.get("deltas") not in gone])
        offer = F.struct("priority", "sequence", "event_id")
        folded = rows.groupBy("native_session_id").agg(F.sum("event_count").alias("event_count"), F.sum("content_bytes").alias("content_bytes"), F.min_by("title", F.when(F.col("event_id").isNotNull(), offer)).alias("title"))
        return folded.where("event_count > 0")

    def rebuild_statistics(self) -> None:
        """Folds what commits changed into one part, made anew from the events: where the revision has risen."""
        old = [c.parts["deltas"] for c in self.commits() if "deltas" in c.parts]
        self.transact("statistics", None, lambda _: {"deltas": deltas(self.events())}, replaces=old)

    def maintain(self, target: str, keep_handoffs: int = 1) -> tuple[Store, MaintenanceReport]:
        """A compacted copy of the store without what retention drops, and what was dropped.

        The copy remembers every batch, id floor, file state and removal, so that streams go on with it.
        """
        commits = self.commits()
        after = Store(self.spark, target, self.conversation_only)
        events, raws = self.events(), self._read("raws", commits).drop("number")
        kept = keep_conversation(events).join(legacy_envelopes(events).select("event_id"), "event_id", "left_anti")
        lost = orphans(raws.join(events.select("raw_object_id").distinct(), "raw_object_id", "left_semi"), kept, "raw_object_id").select("raw_object_id")
        handoffs, shots = self.table("handoffs"), self.table("snapshots")
        newest = latest_per_group(handoffs.withColumn("id", F.col("handoff_id")), "global_id", keep_handoffs).drop("id")
        left = shots.join(newest.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
        last = self._read("cursors", commits).groupBy("source_id").agg(F.max_by(F.struct("collector_id", "source_generation", "byte_offset", "next_sequence", "updated_at"), "number").alias("c")).select("source_id", "c.*")
        # A removal is remembered beside what retention dropped.
        removed = self._read("removed", commits).drop("number").unionByName(events.join(kept.select("event_id"), "event_id", "left_anti").select("event_id", "source_generation")).distinct()
        frames = {"events": kept, "raws": raws.join(lost, "raw_object_id", "left_anti"), "states": self.states(), "cursors": last, "audits": self.table("audits"), "blobs": self.table("blobs"), "handoffs": newest, "snapshots": left, "removed": removed, "summaries": self.summaries(), "decisions": self.table("decisions"), "candidates": self.candidates(), "globals": self.globals(), "calls": self._read("calls", commits).drop("number").distinct(), "deltas": deltas(kept)}
        whole = Commit(0, "maintenance", 0, 0, self.watermark(), self.revision())
        for name, frame in frames.items():
            after._add(whole, name, frame, whole_ids=True)
        after._put(whole)
        seen: dict[tuple[str, int], Commit] = {(c.stream, c.batch): c for c in commits}
        for k, c in enumerate(seen.values()):
            after._put(Commit(k + 1, c.stream, c.batch, whole.top, whole.top, whole.revision, {}, {n: 0 for n in c.counts}))
        report = MaintenanceReport(events.count() - whole.counts["events"], handoffs.count() - whole.counts["handoffs"], shots.count() - whole.counts["snapshots"], raws.count() - whole.counts["raws"])
        return after, report


def places(rows: DataFrame, of: str, at: str | None) -> dict[str, list[int]] | None:
    """Of each generation or path the least and greatest offset of its rows, all offsets without ``at``; None if there are more than FEW."""
    whole = [-ANYWHERE, ANYWHERE]
    low, high = (F.min(at), F.max(at)) if at else (F.lit(None).cast("long"),) * 2
    found = rows.groupBy(F.coalesce(of, F.lit("")).alias("of")).agg(low.alias("low"), high.alias("high")).limit(FEW + 1).collect()
    return {r["of"]: whole if r["low"] is None else [r["low"], r["high"]] for r in found} if len(found) <= FEW else None


def deltas(events: DataFrame, sign: int = 1) -> DataFrame:
    """What events change in their sessions' statistics: counts with a sign, and of added ones the best title they offer."""
    title, priority = title_candidate(F.col("kind"), F.col("payload_json"), DISPOSABLE)
    rows = events.select("native_session_id", "canonical_bytes", title.alias("title"), priority.alias("priority"), "sequence", "event_id")
    best = F.min_by(F.struct("title", "priority", "sequence", "event_id"), F.struct("priority", "sequence", "event_id"))
    best = best if sign > 0 else F.lit(None).cast("struct<title:string,priority:int,sequence:bigint,event_id:string>")
    grouped = rows.groupBy("native_session_id").agg((F.count(F.lit(1)) * sign).alias("event_count"), (F.sum("canonical_bytes") * sign).alias("content_bytes"), best.alias("best"))
    return grouped.select("native_session_id", "event_count", "content_bytes", "best.*")


def verified_blobs(raws: DataFrame) -> DataFrame:
    """Raws whose bytes are what their hash says."""
    return raws.where(F.concat(F.lit("sha256:"), F.sha2("bytes", 256)) == F.col("blob_hash"))


def cursors(updates: DataFrame) -> DataFrame:
    """The last cursor of each source: updates(source_id, batch, ...)."""
    return updates.groupBy("source_id").agg(F.max_by(F.struct(*(c for c in updates.columns if c != "source_id")), "batch").alias("c")).select("source_id", "c.*")


def with_times(events: DataFrame) -> DataFrame:
    """Adds the ordering columns of the original timestamps."""
    return events.withColumns({"ts_seconds": ch.seconds(F.col("timestamp")), "ts_nanos": ch.nanos(F.col("timestamp"))})


class RecordConflict(ValueError):
    """A request that was answered with another record before."""


RECORDS = "request_id string, global_id string, kind string, content string, provenance_id string, created_at string"


def add_record(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """Records with one more; a repeated request changes nothing, one that differs raises RecordConflict."""
    old = records.select("request_id", F.struct("global_id", "kind", "content").alias("old"))
    joined = fresh.join(old, "request_id", "left")
    if joined.where(F.col("old").isNotNull() & (F.col("old") != F.struct("global_id", "kind", "content"))).limit(1).count():
        raise RecordConflict("the request was used for another record")
    return records.unionByName(joined.where("old is null").drop("old"))


def create_global(globals_: DataFrame, fresh: DataFrame) -> DataFrame:
    """Global sessions with one more; the same again changes nothing, another objective raises RecordConflict."""
    old = globals_.select("global_id", F.col("objective").alias("old"))
    joined = fresh.join(old, "global_id", "left")
    if joined.where("old is not null and old <> objective").limit(1).count():
        raise RecordConflict("the session has another objective")
    return globals_.unionByName(joined.where("old is null").drop("old"))
