"""One function for each question that clients ask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import text as t
from threadlake.operators import correlation, handoff, overview, search, timeline
from threadlake.operators.timeline import page_size
from threadlake.streaming import index
from threadlake.streaming.store import Store

AGENT_PAGE, AGENT_SESSIONS = 100, 50


class Service:
    """Queries over an event log and, where they matter, an audit of memberships and tables of sessions."""

    def __init__(self, log: DataFrame, audit: DataFrame | None = None, globals_: DataFrame | None = None, handoffs: DataFrame | None = None, store: Store | None = None) -> None:
        self.store = store
        self.log, self.audit, self.globals_, self.handoffs = log, audit, globals_, handoffs

    @classmethod
    def of(cls, store: Store) -> Service:
        """The questions to a store as it is now."""
        return cls(store.events(), store.table("decisions"), store.globals(), store.table("handoffs"), store)

    def session_tools(self) -> DataFrame:
        return overview.session_tools(self.log)

    def native_sessions(self, after: str | None = None, limit: int | None = None, family: str | None = None) -> tuple[list, str | None]:
        """A page of sessions with their statistics, and the next cursor."""
        size = page_size(limit)
        cursor = None if after is None else search.decode_cursor("sessions", after)
        page = overview.session_page(overview.session_list(self.log), cursor, size + 1, family)
        rows, more = timeline.page_with_next(page, size, "native_session_id")
        return rows, None if more is None else search.encode_cursor("sessions", more)

    def native_session(self, name: str) -> DataFrame:
        return overview.session_list(self.log.where(F.col("native_session_id") == name))

    def events_page(self, after: str | None = None, limit: int | None = None, session: str | None = None, kind: str | None = None) -> tuple[list, str | None]:
        size = page_size(limit)
        cursor = None if after is None else search.decode_cursor("events", after)
        rows, more = timeline.page_with_next(timeline.events_page(self.log, cursor, size + 1, session, kind), size, "event_id")
        return rows, None if more is None else search.encode_cursor("events", more)

    def event_detail(self, name: str) -> DataFrame:
        return self.log.where(F.col("event_id") == name)

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """Events that hold all words, with what they show and their sessions; by the store's index where there is one."""
        found = search.search(self.log, query, page_size(limit)) if self.store is None else index.search(self.store, query, page_size(limit))
        hits = found.withColumn("content", t.event_content(F.col("payload_json")))
        shown = self.log.join(hits.select("native_session_id").distinct(), "native_session_id", "left_semi")
        return search.with_session(hits, overview.session_list(shown))

    def search_query(self, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
        """The full query language; limits are brought into range."""
        return search.search_query(self.log, query, max(1, min(AGENT_PAGE, limit)), offset)

    def recent_sessions(self, limit: int = 20, offset: int = 0, family: str | None = None) -> DataFrame:
        """Newest sessions, titles redacted and cut."""
        rows = overview.recent_sessions(self.log, offset, max(1, min(AGENT_SESSIONS, limit)), family)
        return rows.withColumn("title", t.excerpt(t.redact(F.col("title")), t.TITLE_BYTES)["text"])

    def conversation(self, session: str, most: int = 50) -> DataFrame:
        """The newest messages of a session: role, redacted text and whether it was cut."""
        rows = timeline.recent_conversation(self.log, session, max(1, min(AGENT_PAGE, most)))
        cut = t.excerpt(t.redact(F.coalesce("text", F.lit(""))), t.MESSAGE_BYTES)
        return rows.withColumn("cut", cut).select("event_id", F.replace("kind", F.lit("_message"), F.lit("")).alias("role"), F.col("cut.text").alias("text"), F.col("cut.truncated").alias("text_truncated"), "truncated")

    def members(self, global_id: str) -> DataFrame:
        return correlation.memberships(self.audit).where(F.col("global_id") == global_id).orderBy("native_session_id")

    def candidates(self) -> DataFrame:
        return correlation.candidates(correlation.pair_scores(correlation.summaries(self.log)))

    def current_context(self) -> DataFrame:
        return handoff.current_context(correlation.memberships(self.audit), self.globals_)

    def latest_handoff(self, global_id: str) -> DataFrame:
        return handoff.latest_handoff(self.handoffs.where(F.col("global_id") == global_id))

    def current_handoff(self) -> DataFrame:
        return handoff.stale(handoff.latest_handoff(self.handoffs), self.globals_)

    def refresh_handoffs(self, records: DataFrame | None = None) -> DataFrame:
        return handoff.handoffs(self.log, correlation.memberships(self.audit), self.globals_, records)
