"""Full-text search: phrases, and a query language over them."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import text as t
from threadlake.functions.chronology import ascending

MOST_QUERY_BYTES = 256


class QueryError(ValueError):
    """A query that can't be read."""


def with_tokens(log: DataFrame) -> DataFrame:
    """The log with its search tokens, each between spaces in one string: ' a b c '."""
    return log.withColumn("searchable", F.concat(F.lit(" "), F.array_join(t.tokens(t.search_text(F.col("payload_json"))), " "), F.lit(" ")))


def phrase(words: str, searchable: Column) -> Column:
    """Whether the tokens of a phrase stand side by side; a phrase without tokens matches nothing."""
    tokens = t.folded_tokens(words)
    return F.contains(searchable, F.lit(" " + " ".join(tokens) + " ")) if tokens else F.lit(False)


def keyword_terms(query: str) -> list[str]:
    """The words of a plain query; QueryError if it is empty or too long."""
    if not query.strip() or len(query.encode()) > MOST_QUERY_BYTES:
        raise QueryError("the query must have 1 to 256 bytes")
    return query.split()


def keyword_filter(query: str, searchable: Column) -> Column:
    """All words of a plain query, each as a phrase (a-b is a beside b)."""
    found = F.lit(True)
    for word in keyword_terms(query):
        found = found & phrase(word, searchable)
    return found


def search(log: DataFrame, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Events that hold all words, in order of time."""
    rows = with_tokens(log).where(keyword_filter(query, F.col("searchable"))).drop("searchable")
    return rows.orderBy(*ascending()).offset(offset).limit(limit)


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()^+,:])|([^\s"()^+,:*]+)|(\*))')


class _Reader:
    """expr := and (OR and)*; and := not ((AND)? not)*; not := item (NOT item)*; item := (expr) | NEAR(...) | phrase."""

    def __init__(self, query: str) -> None:
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(query.rstrip()):
            m = _LEX.match(query, at)
            if not m:
                raise QueryError("unreadable query")
            at = m.end()
            if m[1] is not None:
                self.items.append(("phrase", m[1].replace('""', '"')))
            elif m[2]:
                self.items.append((m[2], m[2]))
            elif m[4]:
                self.items.append(("*", "*"))
            else:
                self.items.append((m[3] if m[3] in ("AND", "OR", "NOT", "NEAR") else "word", m[3]))
        if not self.items:
            raise QueryError("empty query")
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.items[self.at + ahead][0] if self.at + ahead < len(self.items) else ""

    def take(self, kind: str) -> str:
        if self.peek() != kind:
            raise QueryError(f"expected {kind}")
        self.at += 1
        return self.items[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek():
            raise QueryError("unexpected " + self.peek())
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.peek() == "OR":
            self.at += 1
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.without()
        while self.peek() in ("AND", "phrase", "word", "(", "NEAR", "^"):
            if self.peek() == "AND":
                self.at += 1
            tree = ("and", tree, self.without())
        return tree

    def without(self) -> tuple:
        tree = self.item()
        while self.peek() == "NOT":
            self.at += 1
            tree = ("not", tree, self.item())
        return tree

    def item(self) -> tuple:
        if self.peek() == "(":
            self.at += 1
            tree = self.either()
            self.take(")")
            return tree
        if self.peek() == "NEAR" and self.peek(1) == "(":
            self.at += 2
            parts, distance = [], 10
            while self.peek() in ("phrase", "word"):
                parts.append(self.text())
            if self.peek() == ",":
                self.at += 1
                number = self.take("word")
                if not number.isdigit():
                    raise QueryError("NEAR needs a number")
                distance = int(number)
            self.take(")")
            if not parts:
                raise QueryError("NEAR needs phrases")
            return ("near", parts, distance)
        if self.peek() == "word" and self.peek(1) == ":":
            if self.take("word") != "searchable_text":
                raise QueryError("no such column")
            self.at += 1
            return self.item()
        first = self.peek() == "^"
        self.at += first
        return ("phrase", *self.text(), first)

    def text(self) -> tuple[str, bool]:
        """A phrase, its parts joined by +, and whether its last token is a prefix."""
        if self.peek() not in ("phrase", "word"):
            raise QueryError("expected a phrase")
        words = [self.take(self.peek())]
        while self.peek() == "+":
            self.at += 1
            if self.peek() not in ("phrase", "word"):
                raise QueryError("expected a phrase")
            words.append(self.take(self.peek()))
        prefix = self.peek() == "*"
        self.at += prefix
        return " ".join(words), prefix


def _near(parts: list[tuple[str, bool]], distance: int, searchable: Column) -> Column:
    """Phrases in any order with at most ``distance`` tokens between neighbours, by the places of tokens in Arrow batches."""
    wanted = [(t.folded_tokens(words), prefix) for words, prefix in parts]
    if not all(tokens for tokens, _ in wanted):
        return F.lit(False)
    sizes = [len(tokens) for tokens, _ in wanted]

    @F.pandas_udf("boolean")
    def near(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: _reaches([_spots(text.split(), *phrase) for phrase in wanted], sizes, distance))

    return near(F.coalesce(searchable, F.lit("")))


def _spots(tokens: list[str], phrase: list[str], prefix: bool) -> list[int]:
    """Where a phrase begins."""
    n = len(phrase)
    fits = lambda i: tokens[i : i + n - 1] == phrase[:-1] and (tokens[i + n - 1].startswith(phrase[-1]) if prefix else tokens[i + n - 1] == phrase[-1])
    return [i for i in range(len(tokens) - n + 1) if fits(i)]


def _reaches(spots: list[list[int]], sizes: list[int], distance: int) -> bool:
    """Whether occurrences of all phrases can be chained; states are sets of phrases with the ends they reach."""
    order = sorted((at, k) for k, places in enumerate(spots) for at in places)
    states: dict[int, set[int]] = {}
    for at, k in order:
        bit, end = 1 << k, at + sizes[k] - 1
        grown = {bit}
        for used, ends in states.items():
            if not used & bit and any(e < at <= e + 1 + distance for e in ends):
                grown.add(used | bit)
        for used in grown:
            if used == (1 << len(spots)) - 1:
                return True
            # Ends too far back for anything that comes later are dropped.
            states[used] = {e for e in states.get(used, ()) if e + 1 + distance >= at} | {end}
    return False


def _column(tree: tuple, searchable: Column) -> Column:
    kind = tree[0]
    if kind in ("and", "or", "not"):
        a, b = _column(tree[1], searchable), _column(tree[2], searchable)
        return a & b if kind == "and" else a | b if kind == "or" else a & ~b
    if kind == "near":
        return _near(tree[1], tree[2], searchable)
    _, words, prefix, first = tree
    tokens = t.folded_tokens(words)
    if not tokens:
        return F.lit(False)
    text = " " + " ".join(tokens) + ("" if prefix else " ")
    return F.startswith(searchable, F.lit(text)) if first else F.contains(searchable, F.lit(text))


def query_filter(query: str, searchable: Column) -> Column:
    """The full query language: phrases, prefix*, ^first, AND, OR, NOT, NEAR and brackets."""
    return _column(_Reader(query).whole(), searchable)


def search_query(log: DataFrame, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Events that a query of the full language matches, in order of time."""
    rows = with_tokens(log).where(query_filter(query, F.col("searchable"))).drop("searchable")
    return rows.orderBy(*ascending()).offset(offset).limit(limit)


# The index: a row for each token of each event, in buckets by token, so that a search reads its words' buckets only.

BUCKETS = 256


def postings(log: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, token, event_id, places): an event's tokens with their places. Built once per event, then appended to."""
    listed = log.select("event_id", F.posexplode(t.tokens(t.search_text(F.col("payload_json")))).alias("place", "token"))
    grouped = listed.groupBy("token", "event_id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return grouped.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket"), "token", "event_id", "places")


def write_index(log: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Appends the postings of events to an index; give it the events of a batch that it doesn't hold."""
    postings(log, buckets).repartition("bucket").sortWithinPartitions("token").write.partitionBy("bucket").mode("append").parquet(path)


def _back(i: int) -> Callable[[Column], Column]:
    return lambda place: place - i


def indexed_ids(index: DataFrame, query: str, buckets: int = BUCKETS) -> DataFrame:
    """Ids of the events that hold all words of a plain query, each word's tokens side by side."""
    found = None
    for word in keyword_terms(query):
        tokens = t.folded_tokens(word)
        hits = None
        for i, token in enumerate(tokens):
            bucket = F.pmod(F.xxhash64(F.lit(token)), F.lit(buckets)).cast("int")
            starts = F.transform("places", _back(i))
            one = index.where((F.col("bucket") == bucket) & (F.col("token") == token)).select("event_id", starts.alias("starts"))
            hits = one if hits is None else hits.join(one.withColumnRenamed("starts", "more"), "event_id").select("event_id", F.array_intersect("starts", "more").alias("starts"))
        hits = index.select("event_id").limit(0) if hits is None else hits.where(F.size("starts") > 0).select("event_id").distinct()
        found = hits if found is None else found.join(hits, "event_id", "left_semi")
    return found


def indexed_search(log: DataFrame, index: DataFrame, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """``search`` by the index: only events that hold the words are read."""
    return log.join(indexed_ids(index, query), "event_id", "left_semi").orderBy(*ascending()).offset(offset).limit(limit)


def with_session(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Hits with what lists show of their sessions."""
    shown = sessions.select("native_session_id", F.col("title").alias("session_title"), F.col("event_count").alias("session_events"))
    return hits.join(shown, "native_session_id")


def encode_cursor(scope: str, value: str) -> str:
    return f"v1:{scope}:{value}"


def decode_cursor(scope: str, cursor: str) -> str:
    """The value of a cursor; ValueError if it belongs to something else."""
    version, found, value = (cursor.split(":", 2) + ["", ""])[:3]
    if version != "v1" or found != scope or not value:
        raise ValueError("invalid cursor")
    return value
