"""Sessions: statistics, titles, spans, counts and the tables that lists show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as t
from threadlake.functions.chronology import order_key
from threadlake.schema import CONVERSATION, DISPOSABLE

OVERVIEW = ("event_id", "native_session_id", "sequence", "kind", "tool_family", "cwd", "ts_seconds", "ts_nanos", "canonical_bytes", "ingestion_id")


def event_overview(log: DataFrame) -> DataFrame:
    """Events without their payloads; Parquet then never reads them."""
    return log.select(*OVERVIEW)


def session_statistics(log: DataFrame) -> DataFrame:
    """Per session: events, bytes, and the title of least (priority, sequence, event_id)."""
    title, priority = t.title_candidate(F.col("kind"), F.col("payload_json"), DISPOSABLE)
    offered = log.select("native_session_id", "canonical_bytes", "sequence", "event_id", title.alias("title"), priority.alias("priority"))
    return offered.groupBy("native_session_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("canonical_bytes").alias("content_bytes"),
        F.min_by("title", F.struct("priority", "sequence", "event_id")).alias("title"),
    )


def with_statistics(sessions: DataFrame, statistics: DataFrame) -> DataFrame:
    """Sessions with zeros where they have no events."""
    joined = sessions.join(statistics, "native_session_id", "left")
    return joined.withColumns({"event_count": F.coalesce("event_count", F.lit(0).cast("long")), "content_bytes": F.coalesce("content_bytes", F.lit(0).cast("long"))})


def native_sessions(log: DataFrame) -> DataFrame:
    """A row per session: family, and when the first- and last-ingested events were."""
    first, last = F.struct("ingestion_id", "event_id"), F.struct("ingestion_id", "event_id")
    return log.groupBy("native_session_id").agg(F.min_by("tool_family", first).alias("tool_family"), F.min_by("ts_seconds", first).alias("started_at"), F.max_by("ts_seconds", last).alias("ended_at"))


def latest_activity(log: DataFrame) -> DataFrame:
    """The last event's time of each session."""
    return log.groupBy("native_session_id").agg(F.max(F.struct("ts_seconds", "ts_nanos")).alias("last")).select("native_session_id", F.col("last.ts_seconds").alias("last_seconds"), F.col("last.ts_nanos").alias("last_nanos"))


def session_list(log: DataFrame) -> DataFrame:
    """What a list of sessions shows: title (else the id), size, last activity."""
    title, priority = t.title_candidate(F.col("kind"), F.col("payload_json"), DISPOSABLE)
    offered = log.select("native_session_id", "canonical_bytes", "sequence", "event_id", "ingestion_id", "tool_family", "ts_seconds", "ts_nanos", title.alias("title"), priority.alias("priority"))
    listed = offered.groupBy("native_session_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("canonical_bytes").alias("content_bytes"),
        F.min_by("title", F.struct("priority", "sequence", "event_id")).alias("title"),
        F.max(F.struct("ts_seconds", "ts_nanos")).alias("last"),
        F.min_by("tool_family", F.struct("ingestion_id", "event_id")).alias("tool_family"),
    )
    listed = listed.withColumns({"last_seconds": F.col("last.ts_seconds"), "last_nanos": F.col("last.ts_nanos")})
    bounded = t.bounded_title(F.col("title"))
    title = F.when(bounded.isNull() | (bounded == ""), F.col("native_session_id")).otherwise(bounded)
    return listed.withColumn("title", title).select("native_session_id", "tool_family", "title", "event_count", "content_bytes", "last_seconds", "last_nanos")


def recent_sessions(log: DataFrame, offset: int, limit: int, family: str | None = None) -> DataFrame:
    """Sessions by last activity, newest first; those without events come last."""
    rows = session_list(log)
    if family is not None:
        rows = rows.where(F.col("tool_family") == family)
    return rows.orderBy(F.col("last_seconds").desc(), F.col("last_nanos").desc(), F.col("native_session_id").desc()).offset(offset).limit(limit)


def session_page(sessions: DataFrame, after: str | None, limit: int, family: str | None = None) -> DataFrame:
    """Sessions in order of id, behind a cursor; ask for one more than a page to see whether there is a next."""
    if after is not None:
        sessions = sessions.where(F.col("native_session_id") > after)
    if family is not None:
        sessions = sessions.where(F.col("tool_family") == family)
    return sessions.orderBy("native_session_id").limit(limit)


def session_tools(log: DataFrame) -> DataFrame:
    return native_sessions(log).groupBy("tool_family").agg(F.count(F.lit(1)).alias("sessions")).orderBy("tool_family")


def resource_counts(log: DataFrame) -> DataFrame:
    """One row: events, conversation events, disposable events, sessions and bytes, in one pass."""
    kind = F.col("kind")
    return log.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(kind.isin(*CONVERSATION)).alias("conversation_events"),
        F.count_if(kind.isin(*DISPOSABLE)).alias("disposable_events"),
        F.sum("canonical_bytes").alias("content_bytes"),
    )


def kind_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def watermark(log: DataFrame, floor: int) -> DataFrame:
    """The greatest ingestion id ever given: of the log, or the floor that outlives deletions."""
    return log.agg(F.greatest(F.coalesce(F.max("ingestion_id"), F.lit(0).cast("long")), F.lit(floor).cast("long")).alias("watermark"))


def changed_sessions(log: DataFrame, after: int, upto: int) -> DataFrame:
    """Sessions with events ingested in (after, upto], in order."""
    return log.where((F.col("ingestion_id") > after) & (F.col("ingestion_id") <= upto)).select("native_session_id").distinct().orderBy("native_session_id")


def _day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def session_buckets(log: DataFrame) -> DataFrame:
    """Sessions by day of last activity and by size."""
    size = F.when(F.col("content_bytes") < 10_000, "small").when(F.col("content_bytes") < 100_000, "medium").otherwise("large")
    rows = session_list(log).select(_day(F.col("last_seconds")).alias("day"), size.alias("size"))
    return rows.groupBy("day", "size").agg(F.count(F.lit(1)).alias("sessions"))


# What groups of sessions are called by size.
SIZES = ((10_000, "Small (< 10 KB)"), (100_000, "Medium (10–100 KB)"), (None, "Large (≥ 100 KB)"))
SHOWN = 50


def group_label(group: str) -> Column:
    """What a session's group is called; group: none, topic, date or size."""
    if group == "topic":
        return F.col("title")
    if group == "date":
        return F.coalesce(_day(F.col("last_seconds")), F.lit("Unknown date"))
    if group == "size":
        label = F.lit(SIZES[-1][1])
        for most, name in reversed(SIZES[:-1]):
            label = F.when(F.col("content_bytes") < most, name).otherwise(label)
        return label
    return F.lit("All sessions")


def session_tree(sessions: DataFrame, group: str = "none", by: str = "recent", show: int = SHOWN) -> DataFrame:
    """A listing's tree: a row for all tools, one for each, and one for each group of a tool.

    (tool_family, label, sessions, content_bytes, shown): null tool and label stand for
    all. shown: the first ids of a group in order (title, size or recent), as many as a page shows, so that no row grows with its group.
    """
    labelled = sessions.withColumn("label", group_label(group))
    counts = labelled.groupingSets([["tool_family", "label"], ["tool_family"], []], "tool_family", "label").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("sessions"), F.sum("content_bytes").alias("content_bytes"))
    order = {"title": ["title", "native_session_id"], "size": [F.col("content_bytes").desc(), "native_session_id"], "recent": [F.col("last_seconds").desc(), "native_session_id"]}[by]
    ranked = labelled.withColumn("place", F.row_number().over(Window.partitionBy("tool_family", "label").orderBy(*order))).where(F.col("place") <= show)
    lists = ranked.groupBy("tool_family", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "native_session_id"))), lambda x: x["native_session_id"]).alias("shown"))
    tree = counts.join(lists.withColumn("level", F.lit(0).cast("long")), ["tool_family", "label", "level"], "left")
    return tree.select("tool_family", "label", "sessions", "content_bytes", "shown")


def session_spans(log: DataFrame) -> DataFrame:
    """First and last event times, first workspace and first user text of each session."""
    key = order_key()
    return log.groupBy("native_session_id").agg(
        F.min_by("ts_seconds", key).alias("start_seconds"),
        F.max_by("ts_seconds", key).alias("end_seconds"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), key)).alias("cwd"),
        F.min_by("text", F.when((F.col("kind") == "user_message") & F.col("text").isNotNull(), key)).alias("first_user_text"),
    )


def workspace_sessions(log: DataFrame, cwd: str) -> DataFrame:
    """Sessions whose workspace is the path, whatever slashes end it."""
    return log.where(F.rtrim(F.col("cwd"), F.lit("/")) == cwd.rstrip("/")).groupBy("native_session_id").agg(F.count(F.lit(1)).alias("n"))


def filter_sessions(sessions: DataFrame, query: str) -> DataFrame:
    """Sessions whose title, id or family holds a text, whatever its case."""
    low = F.lit(query.lower())
    return sessions.where(F.contains(F.lower("title"), low) | F.contains(F.lower("native_session_id"), low) | F.contains(F.lower("tool_family"), low))


def tool_inventory(tools: DataFrame, branches: DataFrame) -> DataFrame:
    """tools(tool_family, sessions) beside branches(tool_family, branch): every family of either, with both."""
    seen = branches.groupBy("tool_family").agg(F.array_sort(F.collect_set("branch")).alias("branches"))
    return tools.join(seen, "tool_family", "full").select("tool_family", F.coalesce("sessions", F.lit(0).cast("long")).alias("sessions"), F.coalesce("branches", F.array().cast("array<string>")).alias("branches"))


def present(known: DataFrame, found: DataFrame) -> DataFrame:
    """Of what is remembered by path, what a scan still finds."""
    return known.join(found.select("path").distinct(), "path", "left_semi")


def sort_sessions(sessions: DataFrame, by: str) -> DataFrame:
    """by: title, size or recent."""
    order = {"title": [F.col("title"), F.col("native_session_id")], "size": [F.col("content_bytes").desc(), F.col("native_session_id")], "recent": [F.col("last_seconds").desc(), F.col("native_session_id")]}
    return sessions.orderBy(*order[by])
