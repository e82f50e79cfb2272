"""The search index as segments of the store, kept by a stream over its commits.

A batch's new events make one segment: postings in buckets by token, added by one
commit. Removed events stay in their segments and are passed over, until a merge
leaves them out. Where FAN segments of one size class stand, a commit puts a merged one in
their place, so a search opens a bucket of few segments, however many commits
there were. What is searched is the segments that no later commit has replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlake.functions import text as t
from threadlake.functions.chronology import ascending
from threadlake.operators import search as se
from threadlake.streaming.reconcile import commit_rows, new_ranges
from threadlake.streaming.store import Commit, Store

STREAM, MERGE = "index", "index-merge"
#: Segments of a size class that are merged into one of the next.
FAN = 4


def live(commits: list[Commit]) -> list[Commit]:
    """The commits whose segments no later one has replaced."""
    gone = {name for c in commits for name in c.replaces}
    return [c for c in commits if c.counts.get("postings") and c.parts["postings"] not in gone]


def covered(commit: Commit, ranges: list[tuple[int, int]] | list[list[int]]) -> bool:
    """Whether a commit has events whose ids lie within a range."""
    return bool(commit.counts.get("events")) and any(lo <= commit.base and commit.top <= hi for lo, hi in ranges)


def unindexed(commits: list[Commit]) -> list[Commit]:
    """Commits with events that no segment has yet."""
    done = [r for c in commits if c.stream == STREAM for r in c.ranges]
    return [c for c in commits if c.counts.get("events") and not covered(c, done)]


def _segments(store: Store, commits: list[Commit]) -> DataFrame:
    """Postings of segments; their bucket is a folder, so that a filter on it opens no other."""
    schema = "token string, event_id string, places array<int>, part string, bucket int"
    if not commits:
        return store.spark.createDataFrame([], schema)
    return store.spark.read.schema(schema).option("basePath", f"{store.path}/postings").parquet(*(f"{store.path}/postings/{c.parts['postings']}" for c in commits))


def removed(store: Store) -> DataFrame:
    return store.table("removed").select("event_id").distinct()


def add_segment(store: Store, batch: int, ranges: list[tuple[int, int]]) -> Commit:
    """Indexes the events whose ingestion ids lie within the ranges."""

    def make(_: list[Commit]) -> dict[str, DataFrame]:
        return {"postings": se.postings(store.events_of([c for c in store.commits() if covered(c, ranges)]))}

    return store.transact(STREAM, batch, make, ranges=ranges)


def merge_segments(store: Store) -> int:
    """Merges size classes with FAN segments or more, the smallest first, until there is none; how many merges."""
    n = 0
    while True:
        classes: dict[int, list[Commit]] = {}
        for c in live(store.commits()):
            classes.setdefault(int(math.log(c.counts["postings"], FAN)), []).append(c)
        full = next((cs for _, cs in sorted(classes.items()) if len(cs) >= FAN), None)
        if full is None:
            return n
        parts = _segments(store, full).drop("part").join(removed(store), "event_id", "left_anti")
        store.transact(MERGE, None, lambda _, parts=parts: {"postings": parts}, replaces=[c.parts["postings"] for c in full])
        n += 1


def index_stream(store: Store, checkpoint: str, once: bool = True, seconds: int = 30) -> StreamingQuery:
    """Follows the store's commits; with ``once``, those that are there."""

    def run(batch: DataFrame, batch_id: int) -> None:
        ranges = new_ranges(batch)
        if ranges:
            add_segment(store, batch_id, ranges)
            merge_segments(store)

    writer = commit_rows(store).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def postings(store: Store) -> DataFrame:
    """The postings of all events that are there."""
    return _segments(store, live(store.commits())).drop("part").join(removed(store), "event_id", "left_anti")


def search(store: Store, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """``search.search`` over the store by its index: only buckets of the query's tokens are opened, and only events that hold its words are read.

    What was stored since the index was brought up to date is scanned.
    """
    commits = store.commits()
    hits = se.indexed_ids(_segments(store, live(commits)), query)
    late = unindexed(commits)
    found = store.events_of([c for c in commits if c not in late]).join(hits, "event_id", "left_semi")
    if late:
        fresh = se.with_tokens(store.events_of(late))
        found = found.unionByName(fresh.where(se.keyword_filter(query, F.col("searchable"))).drop("searchable"))
    return found.orderBy(*ascending()).offset(offset).limit(limit)


def opened(store: Store, query: str, buckets: int = se.BUCKETS) -> list[str]:
    """The files that a search for these words opens."""
    tokens = sorted({token for word in se.keyword_terms(query) for token in t.folded_tokens(word)})
    wanted = [F.pmod(F.xxhash64(F.lit(token)), F.lit(buckets)).cast("int") for token in tokens]
    rows = _segments(store, live(store.commits()))
    rows = rows.where(F.col("bucket").isin(*wanted)) if wanted else rows.limit(0)
    return sorted(r[0] for r in rows.select("_metadata.file_path").distinct().collect())
