"""Text functions over payloads: fields, titles, redaction, terms and excerpts."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Payload fields by use, in order of precedence.
SEARCH_FIELDS = ("text", "title", "description", "task", "command", "stdout", "output", "content", "message")
CONTENT_FIELDS = ("text", "command", "stdout", "output", "content", "message")
FACT_FIELDS = ("text", "title", "description", "task")
TITLE_FIELDS = ("thread_title", "title", "name")
REDACTED = "[REDACTED]"
SECRET_PARTS = ("api_key", "password", "secret", "bearer")
SECRET_START = "sk-"
#: Bytes of an excerpt, with its ellipsis.
EXCERPT_BYTES, MESSAGE_BYTES, TITLE_BYTES = 2048, 4096, 200
#: Bytes of text that are split into tokens at once.
SLICE_BYTES = 1 << 18


def payload_string(payload: Column, field: str) -> Column:
    """A payload's field if it is a JSON string, else null."""
    value = F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def first_string(payload: Column, fields: tuple[str, ...]) -> Column:
    return F.coalesce(*(payload_string(payload, f) for f in fields))


def search_text(payload: Column) -> Column:
    """All searchable strings of a payload, one to a line."""
    return F.concat_ws("\n", *(payload_string(payload, f) for f in SEARCH_FIELDS))


def event_content(payload: Column) -> Column:
    """What an event shows: its first content string or else its payload, at most 1000 characters."""
    return F.left(F.coalesce(first_string(payload, CONTENT_FIELDS), payload, F.lit("{}")), F.lit(1000))


def _either_case(word: str) -> str:
    """A pattern for a word in ASCII letters of any case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


SECRET_WORD = f"(?<![^ ])(?:{_either_case(SECRET_START)}[^ ]*|[^ ]*(?:{'|'.join(map(_either_case, SECRET_PARTS))})[^ ]*)"


def collapsed(text: Column) -> Column:
    """The words between Unicode white space, single spaces between them."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" "))


def redact(text: Column) -> Column:
    """Masks words that look like credentials; white space becomes single spaces."""
    return F.regexp_replace(collapsed(text), SECRET_WORD, REDACTED.replace("[", "\\["))


def bounded_title(text: Column, limit: int = 80) -> Column:
    """A title on one line, cut with an ellipsis."""
    flat = collapsed(text)
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)


def objective(text: Column, limit: int = 240) -> Column:
    return F.left(collapsed(text), F.lit(limit))


def content_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, cut to 64 characters, of at least 4 bytes; in order, with repeats."""
    runs = F.split(text, r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(F.transform(runs, lambda t: F.lower(F.left(t, F.lit(64)))), lambda t: F.octet_length(t) >= 4)


def title_candidate(kind: Column, payload: Column, disposable: tuple[str, ...]) -> tuple[Column, Column]:
    """(title, priority) that an event offers: 0 an explicit title, 1 a user's text, 2 none.

    A blank explicit title keeps the user's text from standing in.
    """
    explicit = first_string(payload, TITLE_FIELDS)
    offered = F.coalesce(explicit, F.when(kind == "user_message", payload_string(payload, "text")))
    usable = ~kind.isin(*disposable) & offered.isNotNull() & (F.length(F.regexp_replace(offered, r"(?U)\s+", "")) > 0)
    title = F.when(usable, F.left(offered, F.lit(320)))
    return title, F.when(title.isNull(), 2).when(explicit.isNotNull(), 0).otherwise(1)


def cut_bytes(text: str, limit: int) -> tuple[str, bool]:
    """At most limit bytes, whole characters only, the ellipsis among them; and whether it was cut."""
    data = text.encode()
    if len(data) <= limit:
        return text, False
    return data[: limit - len("…".encode())].decode(errors="ignore") + "…", True


def excerpt(text: Column, limit: int = EXCERPT_BYTES) -> Column:
    """(text, truncated) as ``cut_bytes`` gives them, without Python: the cut moves back to where a character begins."""
    data, room = text.cast("binary"), limit - len("…".encode())

    def within(byte: int) -> Column:
        return F.hex(F.substring(data, byte, 1)).between("80", "BF")

    kept = F.when(~within(room + 1), room).when(~within(room), room - 1).when(~within(room - 1), room - 2).otherwise(room - 3)
    long = F.coalesce(F.octet_length(text) > limit, F.lit(False))
    cut = F.concat(F.substring(data, F.lit(1), kept).cast("string"), F.lit("…"))
    return F.struct(F.when(long, cut).otherwise(text).alias("text"), long.alias("truncated"))


def normalized_remote(remote: Column) -> Column:
    """host/path of a git remote, the host lower-cased and a final .git left out."""
    plain = F.regexp_replace(F.rtrim(remote, F.lit("/")), r"\.git$", "")
    url = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/]+)/(.*)$", 1)
    path = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/]+)/(.*)$", 2)
    host = F.regexp_extract(plain, r"^(?:[^@/:]*@)?([^/:]+):(.*)$", 1)
    tail = F.regexp_extract(plain, r"^(?:[^@/:]*@)?([^/:]+):(.*)$", 2)
    return F.when(url != "", F.concat(F.lower(url), F.lit("/"), path)).when(host != "", F.concat(F.lower(host), F.lit("/"), tail)).otherwise(plain)


def folded_tokens(text: str) -> list[str]:
    """Search tokens: runs of letters and digits, case folded, diacritics left out."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return [t for t in re.split(r"[\W_]+", plain.casefold()) if t]


def token_lists(texts: pa.Array) -> pa.Array:
    """Search tokens of each text; only a slice of them is in Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    # Rows that begin in the same SLICE_BYTES make a slice.
    at = (sizes.cumsum() - sizes) // SLICE_BYTES
    cuts = [0, *((at[1:] != at[:-1]).nonzero()[0] + 1).tolist(), len(texts)]
    parts = [pa.array([[] if t is None else folded_tokens(t) for t in texts.slice(a, b - a).to_pylist()], pa.list_(pa.string())) for a, b in zip(cuts, cuts[1:])]
    return pa.concat_arrays(parts)


def tokens(text: Column) -> Column:
    """Search tokens of a column, in Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        return token_lists(texts)

    return F.arrow_udf(run, "array<string>")(text)


def kind_label(kind: Column) -> Column:
    """A kind as people read it."""
    return F.concat(F.upper(F.left(kind, F.lit(1))), F.replace(F.substring(kind, 2, 1000), F.lit("_"), F.lit(" ")))


def readable_bytes(size: Column) -> Column:
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.concat(F.format_number(size / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(size / (1024 * 1024), 1), F.lit(" MB")))
