"""WARC archives as a chunked record table: written and read back by executors, chunk by chunk.

Writing: payloads become rows (record, chunk number, bytes) of at most CHUNK bytes each; a
task streams them into compressed archives, one gzip member a record, and rolls a file
when it is large. What it returns names the finished files; files of lost or repeated
attempts are named by nobody. Reading: a task streams a file and gives chunk rows
that carry the size and the SHA-1 so far; the last one of a record has those of the
whole payload, which has to agree with the header. So no task holds a record, whatever its size.

Equal payloads (SHA-256) of at least LEAST bytes are stored once, under the greatest key; the others
become revisit records, which hold the size and digest of their payload but not its bytes.
A payload with very many copies is known from its count: there are at most HOT
such ones, which are broadcast; the others meet their copies in a join.

Defined cases: a null payload is empty; a null url leaves its field out; a null key is written
``-``, is the less of any other and so may revisit but is revisited only by its like; rows with one key
and one payload are both responses (neither is greater); an empty table has no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.arrow_text import released
from threadlake.llm.steps import checkpoint_folder, stored

CHUNK, LEAST, HOT = 64 << 10, 1000, 1024
#: Bytes of an archive after which a task begins the next; bytes of a batch of chunk rows.
ROLL, BATCH = 256 << 20, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY, NO_KEY = "urn:page:", "-"
FILES = "file string, records bigint, bytes bigint"
CHUNKS = "file string, record_id string, record_type string, refers_to string, url string, chunk_no int, bytes binary, size_so_far bigint, sha1_so_far string, last boolean, payload_bytes bigint, payload_digest string"


class BadArchive(ValueError):
    """An archive that doesn't hold what its headers say."""


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there."""
    scheme, _, rest = uri.partition(":")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else f"file://{rest}" if scheme == "file" and not rest.startswith("//") else uri if rest else f"file://{uri}")


# Which payloads are stored, and which are only referred to.


def revisits(payloads: DataFrame) -> DataFrame:
    """key, same and head of each payload that an equal one of a greater key stands for: payloads(key, same, size)."""
    large = payloads.where(F.col("size") >= LEAST).select("key", "same")
    groups = stored(large.groupBy("same").agg(F.max("key").alias("head"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and head is not null"))
    total = groups.agg(F.sum("copies").alias("n")).first()["n"] or 0
    often = F.col("copies") * HOT > total
    hot = large.join(F.broadcast(groups.where(often)), "same")
    rest = large.join(F.broadcast(groups.where(often).select("same")), "same", "left_anti").join(groups.where(~often), "same")
    found = hot.unionByName(rest).select("key", "same", "head")
    return found.where("key is null or key < head").distinct()


def chunked(payloads: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunk rows of payloads(key, url, payload, sha1, bytes, refers_to); a revisit has one without bytes, as an empty payload has."""
    whole = f"transform(sequence(0, greatest(0, cast((octet_length(payload) - 1) div {size} as int))), i -> named_struct('chunk_no', i, 'chunk', substring(payload, i * {size} + 1, {size})))"
    rows = payloads.withColumn("chunks", F.when(F.col("refers_to").isNull(), F.expr(whole)).otherwise(F.expr("array(named_struct('chunk_no', 0, 'chunk', cast('' as binary)))")))
    return rows.select("key", "url", "sha1", "bytes", "refers_to", F.inline("chunks"))


# Archives.


def header(key: str, url: str | None, sha1: str, size: int, refers_to: str | None, date: str) -> bytes:
    """The head of a record: WARC fields, and the response's own."""
    inner = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{KEY}{key}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{KEY}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    length = len(inner) + (size if refers_to is None else 0)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + inner


@dataclass
class _Archive:
    """A file that is being written, one gzip member a record."""

    folder: str
    name: str = field(default_factory=lambda: f"{uuid.uuid4().hex}.warc.gz")
    records: int = 0
    size: int = 0

    def __post_init__(self) -> None:
        where, path = file_system(self.folder)
        self.out = where.open_output_stream(f"{path}/{self.name}", compression=None)  # it would compress .gz once more
        self.member = None

    def put(self, data: bytes) -> None:
        if self.member is None:
            self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._write(self.member.compress(data))

    def end_record(self) -> None:
        self.put(b"\r\n\r\n")
        self._write(self.member.flush())
        self.member = None
        self.records += 1

    def _write(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.name, self.records, self.size


def write_archives(chunks: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", roll: int = ROLL) -> DataFrame:
    """Writes chunk rows below a folder; (file, records, bytes) of the finished files, kept.

    A record's chunks have to follow each other within a partition.
    """
    where, path = file_system(folder)
    where.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, left, done = None, 0, []
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                key, url, sha1, size, refers_to, nth, chunk = (x.as_py() for x in row)
                if nth == 0:
                    if archive is not None and archive.size >= roll:
                        done.append(archive.close())
                        archive = None
                    archive = archive or _Archive(folder)
                    archive.put(header(NO_KEY if key is None else key, url, sha1, size, refers_to, date))
                    left = size if refers_to is None else 0
                archive.put(chunk)
                left -= len(chunk)
                if left == 0:
                    archive.end_record()
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "records", "bytes"])

    texts = chunks.select(F.col("key").cast("string"), "url", "sha1", "bytes", F.col("refers_to").cast("string"), "chunk_no", "chunk")
    return stored(texts.mapInArrow(released(run), FILES))


class _Stream:
    """The bytes of a compressed archive, a little at a time."""

    def __init__(self, source, step: int = CHUNK) -> None:
        self.source, self.step, self.rest, self.packed, self.member = source, step, b"", b"", None

    def _more(self) -> bool:
        """Whether there are more bytes; a member that breaks off is an error."""
        if not self.packed:
            self.packed = self.source.read(self.step)
            if not self.packed:
                if self.member is not None:
                    raise BadArchive("a record breaks off")
                return False
        if self.member is None:
            self.member = zlib.decompressobj(31)
        self.rest += self.member.decompress(self.packed, self.step)
        self.packed = self.member.unconsumed_tail
        if self.member.eof:
            self.packed, self.member = self.member.unused_data, None
        return True

    def line(self) -> str | None:
        """Up to the next line end, without it; None at the end of the archive."""
        while b"\r\n" not in self.rest:
            if not self._more():
                if self.rest:
                    raise BadArchive("a header breaks off")
                return None
        line, _, self.rest = self.rest.partition(b"\r\n")
        return line.decode()

    def read(self, most: int) -> bytes:
        """Up to ``most`` bytes, fewer only at a record's end."""
        while len(self.rest) < most and self._more():
            pass
        data, self.rest = self.rest[:most], self.rest[most:]
        return data

    def fields(self) -> dict[str, str]:
        out = {}
        while line := self.line():
            name, _, value = line.partition(":")
            out[name.lower()] = value.strip()
        return out


def _key(field_: str | None) -> str | None:
    key = None if field_ is None else field_.removeprefix(f"<{KEY}").removesuffix(">")
    return None if key == NO_KEY else key


def stream_archive(source, size: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of one archive, without the file's name."""
    stream = _Stream(source)
    while (first := stream.line()) is not None:
        if first != "WARC/1.1":
            raise BadArchive(f"no record begins with {first[:40]!r}")
        fields = stream.fields()
        stream.line()
        inner = stream.fields()
        kind, whole = fields["warc-type"], int(inner["content-length"])
        declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        common = _key(fields["warc-record-id"]), kind, _key(fields.get("warc-refers-to")), fields.get("warc-target-uri")
        if kind == "revisit":
            yield *common, 0, b"", 0, declared, True, whole, declared
        else:
            sha, got, nth = hashlib.sha1(), 0, 0
            while True:
                chunk = stream.read(min(size, whole - got))
                sha.update(chunk)
                got += len(chunk)
                last = got == whole
                if not (chunk or last):
                    raise BadArchive("a payload breaks off")
                if last and sha.hexdigest() != declared:
                    raise BadArchive(f"the payload of {common[0]} isn't what its digest says")
                yield *common, nth, chunk, got, sha.copy().hexdigest(), last, whole, declared
                nth += 1
                if last:
                    break
        if stream.read(4) != b"\r\n\r\n":
            raise BadArchive("a record doesn't end where its length says")


def read_archives(files: DataFrame, folder: str, with_bytes: bool = True, size: int = CHUNK) -> DataFrame:
    """The chunk table of finished archives; a task for each file. Without bytes, a record's last row alone."""
    names = [c.split(" ")[0] for c in CHUNKS.split(", ")]
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = file_system(folder)
        for names_ in batches:
            for name in names_.column(0).to_pylist():
                rows, held = [], 0
                with where.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for row in stream_archive(source, size):
                        if with_bytes or row[8]:
                            rows.append((name, *(row if with_bytes else (*row[:5], None, *row[6:]))))
                            held += 400 + len(row[5]) * with_bytes
                        if held >= BATCH:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.select("file").repartition(max(1, files.count())).mapInArrow(released(run), CHUNKS)


def archive(spark: SparkSession, pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> tuple[DataFrame, str]:
    """Writes a record for each page in the shared folder: the finished files and where they are."""
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), data.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "same": F.sha2("payload", 256)})
    gone = revisits(rows.select("key", "same", F.col("bytes").alias("size"))).select(F.col("key").alias("of"), F.col("same").alias("like"), F.col("head").alias("refers_to"))
    decided = rows.join(gone, (F.col("same") == F.col("like")) & F.col("key").eqNullSafe(F.col("of")), "left").drop("same", "like", "of")
    folder = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    return write_archives(chunked(decided), folder), folder


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, as its archive says."""
    files, folder = archive(pages.sparkSession, pages)
    last = read_archives(files, folder, with_bytes=False).where("last")
    return last.select(F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def oracle(table: str) -> str:
    """DuckDB SQL for the same rows."""
    return f"""with pages_ as (select page_id, coalesce(html, '') as html from {table}),
heads as (select html, max(page_id) as head from pages_ where strlen(html) >= {LEAST} group by html)
select page_id, strlen(p.html)::bigint as payload_bytes, sha1(p.html) as payload_digest,
  case when head > page_id or (page_id is null and head is not null) then 'revisit' else 'response' end as record_type,
  case when head > page_id or (page_id is null and head is not null) then head end as refers_to
from pages_ p left join heads h on p.html = h.html"""
