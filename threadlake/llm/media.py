"""Media columns: interleaved sequences of texts and media, and their stored forms.

``parse_sequences`` reads HTML into one row per page with an ordered array of
structs: texts, and references to media by digest, each with its position and
caption. ``resolve_media`` joins the references with a media table by digest.
``describe_media`` reads the stored bytes back and says what they hold.
``sequences_with_media`` puts the sequences together again, with payloads or
descriptions beside positions and captions.

``store_image`` keeps bytes losslessly as an 8-bit grey image (binary PGM, 64
samples a row, the number of unpadded bytes in its header), ``read_image`` gets
the samples back, ``image_features`` says what they look like.

Defined cases: null HTML is an empty sequence, and stays one; a reference whose
digest no payload has stays, with a null payload and a null description; equal
payloads are stored once per digest; a null or empty text is stored as 64 zero
bytes; repeated rows, and rows with one key or none, each keep their sequence; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.arrow_text import released
from threadlake.llm.steps import stored

ROW = 64
#: References to one digest that a task takes; digests of more up to which their table is broadcast.
HOT, BROADCAST_DIGESTS = 1000, 100_000
BLOCKS = frozenset(("p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "figure", "figcaption", "blockquote", "br", "tr", "ul", "ol", "table", "body", "html"))
HIDDEN = frozenset(("script", "style", "head", "template", "noscript"))
MEDIA = frozenset(("img", "audio", "video", "source"))
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"


class _Sequence(HTMLParser):
    """Texts and media references in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figure: list[int] | None = None
        self.captioning = False

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if not text:
            return
        if self.captioning and self.figure:
            for i in self.figure:
                self.items[i]["caption"] = text
        else:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS or tag in MEDIA:
            self._flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.captioning = True
        elif tag in MEDIA and not self.hidden:
            named = dict(attrs)
            source = named.get("src") or ""
            if source.startswith("sha256:"):
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"position": len(self.items), "kind": tag, "text": None, "digest": source[7:], "caption": named.get("alt")})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS:
            self._flush()
        if tag == "figcaption":
            self.captioning = False
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.words.append(data)


def sequence(html: str | None) -> list[dict]:
    """The ordered items of one page."""
    if not html:
        return []
    reader = _Sequence()
    reader.feed(html)
    reader.close()
    reader._flush()
    return reader.items


def parse_sequences(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, page and items, an ordered array of texts and media references, for every row.

    page names the row, so that rows with one key stay apart. The rows are written
    to the shared folder: their names hold, whatever is computed again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
        page = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                names = pa.array(range(page, page + part.num_rows), pa.int64())
                page += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), names, pa.array([sequence(h.as_py()) for h in part.column(1)], pa.list_(item))], names=["key", "page", "items"])

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(released(run), f"key {kind}, page bigint, items array<{ITEM}>")
    return stored(found).withColumnRenamed("key", key)


def resolve_media(sequences: DataFrame, media: DataFrame, hot: int = HOT, most: int = BROADCAST_DIGESTS) -> DataFrame:
    """page, position, digest and payload of every media reference of the sequences.

    media: rows of (digest, payload); equal digests must have equal payloads. The
    payloads are shuffled once, by digest. A digest that more than ``hot``
    references have is dealt to as many tasks as it needs, its payload with it;
    the table of such digests is broadcast up to ``most`` rows.
    """
    references = sequences.select("page", F.explode("items").alias("item")).where("item.digest is not null").select("page", "item.position", "item.digest")
    often = stored(references.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("digest").alias("hot"), F.ceil(F.col("n") / hot).cast("int").alias("salts")))
    side = F.broadcast(often) if often.count() <= most else often
    dealt = references.join(side, F.col("digest") == F.col("hot"), "left").withColumn("salt", F.pmod(F.xxhash64("page", "position"), F.coalesce("salts", F.lit(1))).cast("int"))
    spread = media.select("digest", "payload").join(side, F.col("digest") == F.col("hot"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    once = spread.groupBy("digest", "salt").agg(F.first("payload").alias("payload"))
    return dealt.drop("hot", "salts").join(once, ["digest", "salt"], "left").select("page", "position", "digest", "payload")


def sequences_with_media(sequences: DataFrame, resolved: DataFrame, key: str, value: str = "payload") -> DataFrame:
    """key and items of every page, each item with its ``value`` of resolved(page, position, value) beside it.

    Positions and captions are those of the page; texts, and references that
    nothing resolves, have a null value; an empty sequence stays empty.
    """
    found = resolved.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("position", value))).alias("found"))
    filled = F.transform("items", lambda x: F.struct(x["position"].alias("position"), x["kind"].alias("kind"), x["text"].alias("text"), x["digest"].alias("digest"), x["caption"].alias("caption"), F.when(F.col("found").isNotNull(), F.try_element_at("found", x["position"])).alias(value)))
    return sequences.join(found, "page", "left").select(key, filled.alias("items"))


def padded(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of ROW."""
    return data + bytes(-len(data) % ROW if data else ROW)


def store_image(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey image, ROW samples wide, of a payload that fills its rows; its header says how many bytes are no padding."""
    return b"P5\n# bytes %d\n%d %d\n255\n" % (n_bytes, ROW, len(payload) // ROW) + payload


def read_image(stored: bytes) -> tuple[bytes, int]:
    """The samples of such an image, and how many of them are no padding."""
    magic, note, size, depth, samples = stored.split(b"\n", 4)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height or not note.startswith(b"# bytes "):
        raise ValueError("not an 8-bit grey image")
    return samples, int(note[8:])


def image_features(samples: bytes) -> str:
    """Mean, spread, share of zero samples, and an 8 x 8 average hash."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    bands = np.linspace(0, len(x), 9).astype(int)
    rows = np.array([x[a : max(b, a + 1)].mean(axis=0) if a < len(x) else np.zeros(ROW) for a, b in zip(bands, bands[1:], strict=False)])
    cells = rows.reshape(8, 8, ROW // 8).mean(axis=2)
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"mean={x.mean():.4f};std={x.std():.4f};zero={(x == 0).mean():.4f};ahash={bits}"


def media_of_texts(docs: DataFrame, text: str) -> DataFrame:
    """(digest, payload): each text's bytes, padded and stored as an image.

    Texts that a task has just met are not stored again; digests stay to be made
    distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[str] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                digests, stored, sizes = [], [], []
                for value in batch.column(0).slice(lo, 256):
                    data = (value.as_py() or "").encode()
                    digest = hashlib.sha256(data).hexdigest()
                    if digest in met:
                        continue
                    if len(met) > 100_000:
                        met.clear()
                    met.add(digest)
                    digests.append(digest)
                    stored.append(store_image(padded(data), len(data)))
                if digests:
                    yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(stored, pa.binary())], names=["digest", "payload"])

    return docs.select(F.col(text).alias("text")).mapInArrow(released(run), "digest string, payload binary")


def pages_of_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A page for each document: a heading, a paragraph, its text's image by digest with a caption, and an end."""
    data = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.encode(data, "UTF-8"), 256)
    html = F.concat(F.lit("<html><body><h1>document</h1><p>Stored as an image.</p><figure><img src=\"sha256:"), digest, F.lit('" alt="text"><figcaption>'), digest, F.lit("</figcaption></figure><p>End of the document.</p></body></html>"))
    return docs.select(F.col(key), html.alias("html"))


DESCRIBED = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def describe_media(resolved: DataFrame) -> DataFrame:
    """page, position and ``media``, a struct of digest columns, of every resolved image, from the samples read back.

    A reference without a payload has a null struct.
    """
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def described(stored: bytes | None) -> dict | None:
        if stored is None:
            return None
        samples, n = read_image(stored)
        return dict(zip([k for k, _ in fields], (n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), image_features(samples)), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                media = pa.array([described(x.as_py()) for x in part.column(2)], pa.struct(fields))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), media], names=["page", "position", "media"])

    kinds = DESCRIBED.replace(" ", ":").replace(",:", ",")
    return resolved.select("page", "position", "payload").mapInArrow(released(run), f"page bigint, position int, media struct<{kinds}>")


def media_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the digest columns of the image on each document's page.

    The pages are parsed, their references joined with the stored images, the
    images read back and described, and the sequences put together again; the
    columns come from the one image of each sequence.
    """
    sequences = parse_sequences(pages_of_texts(docs, key, text), key, "html")
    described = describe_media(resolve_media(sequences, media_of_texts(docs, text)))
    whole = sequences_with_media(sequences, described, key, "media")
    return whole.select(key, F.filter("items", lambda x: x["kind"] == "img")[0]["media"].alias("media")).select(key, "media.*")
