"""Files of JSON lines as a Spark data source that tails them by byte offsets.

Registered as ``jsonl_tail``; options: path (a glob of files that driver and
executors see), chunk (bytes of a partition), batch_bytes (of a stream's batch, 0: no limit)
and checkpoint (of the stream: where a limited one goes on after a restart). Partitions never split a record: each
has the whole lines that begin in it; a batch ends behind a file's last whole line. A file's generation is a hash of its identity
and first line; a replaced or shrunken file is read anew from its start.
"""

from __future__ import annotations

import contextlib
import glob
import hashlib
import json
import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

CHUNK = 4 << 20
FIRST_LINE = 1 << 20
SCHEMA = "path string, generation string, source_offset bigint, value binary"


def generation(path: str) -> str:
    """Names what a path holds: device, inode and first line."""
    status = os.stat(path)
    with open(path, "rb") as f:
        first = f.readline(FIRST_LINE)
    return hashlib.sha256(f"{status.st_dev}:{status.st_ino}:".encode() + first).hexdigest()


def resume(prior: dict | None, current: str, size: int, partial: str | None = None) -> tuple[int, str]:
    """(offset, why): where to go on in a file of this generation and size.

    partial: digest of the unfinished line that was seen there, as it is now.
    """
    if prior is None:
        return 0, "initial"
    if prior["generation"] != current:
        return 0, "replaced"
    if size < prior["offset"]:
        return 0, "truncated"
    if prior.get("partial") and partial is not None and partial != prior["partial"]:
        return 0, "partial_mismatch"
    return prior["offset"], "resumed"


def _digest(path: str, offset: int, size: int) -> str:
    with open(path, "rb") as f:
        f.seek(offset)
        return hashlib.sha256(f.read(size)).hexdigest()


def whole_size(path: str, step: int = 1 << 16) -> tuple[int, int]:
    """(bytes up to the end of the last whole line, size of the file), found from its end."""
    with open(path, "rb") as f:
        size = at = f.seek(0, os.SEEK_END)
        while at:
            begin = max(0, at - step)
            f.seek(begin)
            end = f.read(at - begin).rfind(b"\n")
            if end >= 0:
                return begin + end + 1, size
            at = begin
    return 0, size


def position(path: str) -> dict:
    """Where a file stands: generation, end of its whole lines, and the unfinished line behind that."""
    current = generation(path)
    offset, size = whole_size(path)
    rest = min(size - offset, FIRST_LINE)
    return {"generation": current, "offset": offset, "rest": rest, "partial": _digest(path, offset, rest) if rest else ""}


def read_chunk(path: str, offset: int, target: int = CHUNK) -> bytes:
    """Whole lines from an offset on: about ``target`` bytes, at least one line if one is whole."""
    with open(path, "rb") as f:
        f.seek(offset)
        data = f.read(target)
        while data and b"\n" not in data:
            more = f.read(target)
            if not more:
                return b""
            data += more
    return data[: data.rfind(b"\n") + 1]


def _rows(path: str, current: str, offset: int, data: bytes) -> Iterator[tuple]:
    at = 0
    while (end := data.find(b"\n", at)) >= 0:
        yield path, current, offset + at, data[at : end + 1]
        at = end + 1


class _Span(InputPartition):
    """The lines of a file that begin within [begin, end); the file's part is read from first on."""

    def __init__(self, path: str, current: str, first: int, begin: int, end: int) -> None:
        super().__init__(f"{path}:{begin}")
        self.path, self.current, self.first, self.begin, self.end = path, current, first, begin, end


def spans(path: str, current: str, first: int, end: int, chunk: int) -> list[_Span]:
    return [_Span(path, current, first, a, min(end, a + chunk)) for a in range(first, end, chunk)]


def read_span(span: _Span) -> Iterator[tuple]:
    """Line by line; a line that runs over the end belongs to the span that it begins in."""
    with open(span.path, "rb") as f:
        f.seek(span.begin)
        if span.begin > span.first:
            f.seek(span.begin - 1)
            f.readline()
        while (at := f.tell()) < span.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield span.path, span.current, at, line


class TailReader(DataSourceReader):
    """Batch: every whole line of every file, a partition for each chunk of a file."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in sorted(glob.glob(self.options["path"], recursive=True)):
            at = position(path)
            out += spans(path, at["generation"], 0, at["offset"], int(self.options.get("chunk", CHUNK)))
        return out or [_Span("", "", 0, 0, 0)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        return read_span(partition) if partition.path else iter(())


def whole_before(path: str, first: int, most: int, end: int, step: int = 1 << 16) -> int:
    """The end of the last whole line within ``most`` bytes from first on; of the first line if that is longer."""
    if end - first <= most:
        return end
    with open(path, "rb") as f:
        at = first + most
        while at > first:
            begin = max(first, at - step)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
        f.seek(first)
        f.readline()
        return min(end, f.tell())


def shares(left: dict[str, int], limit: int, turn: str, least: int = 1 << 16) -> dict[str, int]:
    """How many bytes each file may give: even shares, in turn after the file that was served last; what is left over goes round once more."""
    paths = sorted(left)
    order = [p for p in paths if p > turn] + [p for p in paths if p <= turn]
    rest, out = limit, {}
    for most in (max(limit // max(1, len(order)), min(limit, least)), limit):
        for path in order:
            take = min(left[path] - out.get(path, 0), most, rest)
            if take > 0:
                out[path] = out.get(path, 0) + take
                rest -= take
    return out


def last_offset(checkpoint: str) -> dict | None:
    """The last offset that a stream with one source has planned, from its checkpoint folder; None before the first."""
    where, path = fs.FileSystem.from_uri(checkpoint) if "://" in checkpoint else (fs.LocalFileSystem(), checkpoint.removeprefix("file:"))
    found = where.get_file_info(fs.FileSelector(f"{path}/offsets", allow_not_found=True))
    numbers = sorted((int(f.base_name), f.path) for f in found if f.base_name.isdigit())
    if not numbers:
        return None
    with where.open_input_stream(numbers[-1][1]) as f:
        return json.loads(f.read().decode().splitlines()[-1])


def planned(start: dict, paths: list[str], limit: int) -> dict:
    """The end of the next batch: every file's position, or as much of it as the limit admits."""
    before, now, first = json.loads(start["files"]), {}, {}
    for path in paths:
        with contextlib.suppress(FileNotFoundError):
            now[path] = position(path)
            first[path] = _first(path, before.get(path), now[path])
    left = {p: now[p]["offset"] - first[p] for p in now if now[p]["offset"] > first[p]}
    turn = start.get("turn", "")
    if limit and sum(left.values()) > limit:
        given = shares(left, limit, turn)
        for path in left:
            if path not in given:
                if path in before:
                    now[path] = before[path]
                else:
                    del now[path]
                continue
            end = whole_before(path, first[path], given[path], now[path]["offset"])
            if end < now[path]["offset"]:
                now[path] = {"generation": now[path]["generation"], "offset": end, "rest": 0, "partial": ""}
        turn = max(given, key=lambda p: (p <= turn, p))
    return {"files": json.dumps(now, sort_keys=True), "turn": turn}


def _first(path: str, prior: dict | None, to: dict) -> int:
    """Where a file's next batch begins."""
    seen = _digest(path, prior["offset"], prior["rest"]) if prior and prior["rest"] and prior["offset"] + prior["rest"] <= os.path.getsize(path) else None
    return resume(prior, to["generation"], to["offset"], seen)[0]


class TailStreamReader(DataSourceStreamReader):
    """Stream: what came since the last batch, read by executors; the driver sees positions only.

    A limited batch goes on from the last one that was planned. After a restart
    that is the last entry of the checkpoint's own log of offsets.
    """

    def __init__(self, options: dict) -> None:
        self.options = options
        self.chunk, self.limit = int(options.get("chunk", CHUNK)), int(options.get("batch_bytes", 0))
        self.last: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}", "turn": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.last is None and self.limit and self.options.get("checkpoint"):
            self.last = last_offset(self.options["checkpoint"])
        return planned(self.last or self.initialOffset(), sorted(glob.glob(self.options["path"], recursive=True)), self.limit)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = end
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out: list[InputPartition] = []
        for path, to in sorted(after.items()):
            with contextlib.suppress(FileNotFoundError):
                first = _first(path, before.get(path), to)
                if generation(path) == to["generation"]:
                    out += spans(path, to["generation"], first, to["offset"], self.chunk)
        return out

    def read(self, partition: _Span) -> Iterator[tuple]:
        return read_span(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TailReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return TailStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
