"""Timelines: keyset pages, conversations, bounded contexts and groups of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.chronology import ascending, descending, order_key
from threadlake.schema import CHRONOLOGY, CONVERSATION

PAGE_DEFAULT, PAGE_MOST = 50, 200
CONTEXT_EVENTS, CONTEXT_MOST, CONTEXT_BYTES = 256, 512, 4 << 20


def page_size(limit: int | None) -> int:
    """The size asked for, or the default; ValueError outside 1 to 200."""
    size = PAGE_DEFAULT if limit is None else limit
    if not 1 <= size <= PAGE_MOST:
        raise ValueError("limit must be between 1 and 200")
    return size


def events_page(log: DataFrame, after: str | None = None, limit: int = PAGE_DEFAULT, session: str | None = None, kind: str | None = None, upto: int | None = None) -> DataFrame:
    """Events in order, behind the event named by the cursor; ValueError for an unknown cursor."""
    rows = log
    if session is not None:
        rows = rows.where(F.col("native_session_id") == session)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if upto is not None:
        rows = rows.where(F.col("ingestion_id") <= upto)
    if after is not None:
        at = log.where(F.col("event_id") == after).select(*CHRONOLOGY).first()
        if at is None:
            raise ValueError("unknown cursor")
        # The first key alone lets Parquet skip whole row groups.
        rows = rows.where(F.col("ts_seconds") >= at["ts_seconds"]).where(order_key() > F.struct(*(F.lit(at[c]).cast(log.schema[c].dataType) for c in CHRONOLOGY)))
    return rows.orderBy(*ascending()).limit(limit)


def page_with_next(page: DataFrame, size: int, id_column: str) -> tuple[list, str | None]:
    """The rows of a page that was read with one row more, and the cursor of the next."""
    rows = page.collect()
    return rows[:size], rows[size - 1][id_column] if len(rows) > size else None


def recent_conversation(log: DataFrame, session: str, limit: int) -> DataFrame:
    """The newest user and assistant messages of a session, oldest first, and whether there were more."""
    limit = max(1, min(CONTEXT_MOST, limit))
    newest = log.where((F.col("native_session_id") == session) & F.col("kind").isin(*CONVERSATION)).orderBy(*descending()).limit(limit + 1)
    numbered = newest.withColumn("rn", F.row_number().over(Window.orderBy(*descending()))).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return numbered.where(F.col("rn") <= limit).drop("rn").orderBy(*ascending())


def newest_per_session(log: DataFrame, limit: int) -> DataFrame:
    """Of every session, its newest conversation events."""
    w = Window.partitionBy("native_session_id").orderBy(*descending())
    return log.where(F.col("kind").isin(*CONVERSATION)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def bounded_context(log: DataFrame, group: str = "native_session_id", limit: int = CONTEXT_EVENTS, most_bytes: int = CONTEXT_BYTES) -> DataFrame:
    """Of every group, its newest events while their bytes fit; the newest always stays."""
    w = Window.partitionBy(group).orderBy(*descending())
    # A filter on row_number alone comes first, so that Spark can drop rows before the sort is done.
    newest = log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= min(limit, CONTEXT_MOST))
    running = F.sum("canonical_bytes").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return newest.withColumn("running", running).where((F.col("rn") == 1) | (F.col("running") <= most_bytes)).drop("running")


def event_groups(log: DataFrame) -> DataFrame:
    """Numbers the groups of each session: a tool result joins the tool call right before it."""
    w = Window.partitionBy("native_session_id").orderBy(*ascending())
    joins = (F.col("kind") == "tool_result") & (F.lag("kind").over(w) == "tool_call")
    started = log.withColumn("starts", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return started.withColumn("group_no", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("starts")


def native_rank(rows: DataFrame) -> DataFrame:
    """Numbers a session's rows from 0 in order of time and id."""
    return rows.withColumn("native_rank", F.row_number().over(Window.partitionBy("native_session_id").orderBy("ts_seconds", "ts_nanos", "event_id")) - 1)


def merge_events(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both lists, each event once, in order."""
    return current.unionByName(incoming).dropDuplicates(["event_id"]).orderBy(*ascending())


def live_page(page: DataFrame, incoming: DataFrame, size: int = PAGE_MOST) -> tuple[DataFrame, DataFrame]:
    """A page with what came in meanwhile, its newest events only; and one row that says whether anything was new."""
    merged = page.unionByName(incoming).dropDuplicates(["event_id"]).orderBy(*descending()).limit(size).orderBy(*ascending())
    fresh = incoming.join(page.select("event_id"), "event_id", "left_anti")
    return merged, fresh.agg((F.count(F.lit(1)) > 0).alias("new_events"))


def carry_workspace(records: DataFrame) -> DataFrame:
    """Fills workspace fields from the last record of the same file that had them."""
    w = Window.partitionBy("source_path").orderBy("source_offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("cwd", "branch", "head")})


def matched_calls(records: DataFrame) -> DataFrame:
    """Whether a tool result's call stood earlier in its file."""
    w = Window.partitionBy("source_path", "call_id")
    first = F.min(F.when(F.col("kind") == "tool_call", F.col("source_offset"))).over(w)
    return records.withColumn("matched_call", F.when(F.col("kind") == "tool_result", F.coalesce(first < F.col("source_offset"), F.lit(False))))
