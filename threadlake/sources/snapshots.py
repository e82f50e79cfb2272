"""Sources that change in place, as streams that remember what they have read.

``json_snapshots``: whole JSON documents. The offset holds each file's size and time;
a batch has the files that differ, whole, up to about batch_bytes. ``opencode_parts``: text
parts of a SQLite database, with their rank in their session. The offset holds the greatest
update time of the last whole pass and the place of the pass that is going on: a pass reads
the sessions with news since then by keyset, in pages of PAGE_ROWS rows and PAGE_BYTES bytes, of which
a batch has a few. Both go on, after a restart, from the last offset in the checkpoint's log.
"""

from __future__ import annotations

import contextlib
import glob
import json
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from threadlake.functions.identity import sha256
from threadlake.sources.opencode import PAGE_BYTES, PAGE_ROWS
from threadlake.sources.tail import last_offset

DOCUMENTS = "path string, generation string, value binary"
PARTS = "path string, generation string, id string, session_id string, rank bigint, time_created bigint, directory string, title string, message_data string, data string"
#: Pages of a database in one batch.
BATCH_PAGES = 64


def path_generation(path: str) -> str:
    """What a file that is replaced in place is called: its path names it, whatever it holds."""
    return "generation_" + sha256(path)


class _Remembering(DataSourceStreamReader):
    """Goes on from the batch that was planned last, in this run or in an earlier one."""

    start: dict = {}

    def __init__(self, options: dict) -> None:
        self.options = options
        self.last: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return dict(self.start)

    def latestOffset(self) -> dict:  # noqa: N802
        if self.last is None and self.options.get("checkpoint"):
            self.last = last_offset(self.options["checkpoint"])
        return self.after(self.last or self.initialOffset())

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = end
        return self.planned(start, end)

    def after(self, start: dict) -> dict:
        raise NotImplementedError

    def planned(self, start: dict, end: dict) -> list[InputPartition]:
        raise NotImplementedError

    def commit(self, end: dict) -> None:
        pass


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class DocumentReader(_Remembering):
    start = {"files": "{}"}

    def after(self, start: dict) -> dict:
        """Every file as it was, but for changed ones, the longest unchanged first, up to the limit; at least one."""
        known, out, rest = json.loads(start["files"]), {}, int(self.options.get("batch_bytes", 1 << 30))
        now = {}
        for path in glob.glob(self.options["path"], recursive=True):
            with contextlib.suppress(FileNotFoundError):
                status = os.stat(path)
                now[path] = [status.st_size, status.st_mtime_ns]
        changed, first = sorted((p for p in now if known.get(p) != now[p]), key=lambda p: (now[p][1], p)), True
        out = {p: known[p] for p in now if p in known}
        for path in changed:
            if not first and now[path][0] > rest:
                break
            out[path], first = now[path], False
            rest -= now[path][0]
        return {"files": json.dumps(out, sort_keys=True)}

    def planned(self, start: dict, end: dict) -> list[InputPartition]:
        before = json.loads(start["files"])
        return [_File(p) for p, stamp in json.loads(end["files"]).items() if before.get(p) != stamp]

    def read(self, partition: _File) -> Iterator[tuple]:
        """The document as it is now; one that is gone by now has no row."""
        with contextlib.suppress(FileNotFoundError), open(partition.path, "rb") as f:
            yield partition.path, path_generation(partition.path), f.read()


class _Span(InputPartition):
    """Parts of sessions with news since ``mark`` behind one key and up to another (null: no bound)."""

    def __init__(self, mark: int, after: list | None, upto: list | None) -> None:
        super().__init__(json.dumps([mark, after, upto]))
        self.mark, self.behind, self.upto = mark, after, upto


# Text parts by (session, time, id), each with its rank among its session's.
LISTED = """select * from (
  select p.id, p.session_id, p.time_created, s.directory, {title} as title, length(m.data) + length(p.data) as size,
    row_number() over (partition by p.session_id order by p.time_created, p.id) - 1 as rank, m.rowid as m_row, p.rowid as p_row
  from part p join message m on m.id = p.message_id and m.session_id = p.session_id join session s on s.id = p.session_id
  where json_extract(p.data, '$.type') = 'text' and json_type(p.data, '$.text') = 'text' and json_extract(p.data, '$.text') <> ''
    and p.session_id in (select session_id from part where time_updated >= ?))
where (session_id, time_created, id) > (?, ?, ?) order by session_id, time_created, id limit ?"""
FIRST_KEY = ["", -(1 << 62), ""]


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _listed(db: sqlite3.Connection, mark: int, after: list | None, rows: int = PAGE_ROWS, most_bytes: int = PAGE_BYTES) -> list[tuple]:
    """One page: rows behind a key, as many as a page's bounds admit, at least one."""
    titled = any(r[1] == "title" for r in db.execute("pragma table_info(session)"))
    found, size = [], 0
    for row in db.execute(LISTED.format(title="s.title" if titled else "null"), (mark, *(after or FIRST_KEY), rows)):
        size += row[5]
        if found and size > most_bytes:
            break
        found.append(row)
    return found


def _key(row: tuple) -> list:
    return [row[1], row[2], row[0]]


def pages(path: str, mark: int = 0, after: list | None = None, upto: list | None = None) -> Iterator[list[tuple]]:
    """Pages of parts with their payloads, behind one key and up to another."""
    with contextlib.closing(_opened(path)) as db:
        while found := _listed(db, mark, after):
            page = [r for r in found if upto is None or _key(r) <= upto]
            yield [(path, path_generation(path), r[0], r[1], r[6], r[2], r[3], r[4], *db.execute("select m.data, p.data from message m, part p where m.rowid = ? and p.rowid = ?", r[7:9]).fetchone()) for r in page]
            after = _key(found[-1])
            if len(page) < len(found) or after == upto:
                return


class PartReader(_Remembering):
    start = {"mark": -1, "target": -1, "after": ""}

    def after(self, start: dict) -> dict:
        """A few pages on in the pass; at its end the next pass's mark is the update time that it aimed at."""
        if not os.path.exists(self.options["path"]):
            return start
        with contextlib.closing(_opened(self.options["path"])) as db:
            newest = db.execute("select coalesce(max(time_updated), -1) from part").fetchone()[0]
            mark, target, at = start["mark"], start["target"], json.loads(start["after"]) if start["after"] else None
            if newest < mark:  # an older state was put back: everything anew
                mark, at = -1, None
            if at is None:
                if newest <= mark:
                    return start
                target = newest
            for _ in range(int(self.options.get("batch_pages", BATCH_PAGES))):
                page = _listed(db, mark, at)
                if not page:
                    return {"mark": target, "target": target, "after": ""}
                at = _key(page[-1])
            more = bool(_listed(db, mark, at, rows=1))
        return {"mark": mark, "target": target, "after": json.dumps(at)} if more else {"mark": target, "target": target, "after": ""}

    def planned(self, start: dict, end: dict) -> list[InputPartition]:
        if start == end:
            return []
        behind = json.loads(start["after"]) if start["after"] else None
        upto = json.loads(end["after"]) if end["after"] else None
        again = end["mark"] < start["mark"] or (upto is not None and end["mark"] != start["mark"])
        return [_Span(end["mark"] if again else start["mark"], None if again else behind, upto)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        for page in pages(self.options["path"], partition.mark, partition.behind, partition.upto):
            yield from page


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_snapshots"

    def schema(self) -> str:
        return DOCUMENTS

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return DocumentReader(self.options)


class PartSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "opencode_parts"

    def schema(self) -> str:
        return PARTS

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PartReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)
    spark.dataSource.register(PartSource)
