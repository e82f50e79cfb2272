"""Document fingerprints by locally consistent parsing.

A text's code points are the symbols of level 0. On each level, runs of one
symbol become one symbol; then deterministic coin tossing (each symbol against
its left neighbour: the place of the lowest differing bit, and that bit) shrinks
the symbols to labels below 6 that differ between neighbours. Local maxima of
the labels begin phrases, and a phrase's name, a hash of its symbols, is a
symbol of the next level. A cut depends on a few neighbours only, so equal
substrings have equal names inside, wherever they stand.

The fingerprint keeps, for each of ``SLOTS`` slots, a byte of the least name of
the levels from ``LOWEST`` up that falls into it. Two fingerprints are as alike
as their slots agree, which estimates the shared part of all names.

Defined cases: a null text is empty; an empty text's fingerprint has empty
slots, and two such are alike by 1; equal texts have equal fingerprints; a table
of one row is its own next document; null keys come last, ties are ordered by a
hash of the text, so equal rows follow each other; keys that are no whole numbers
are ordered by their string form; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.arrow_text import mixed, prefix_sums, released, span_hash

SLOTS = 128
#: Names of levels from here on count; of short texts, also the level below.
LOWEST = 2
SHORT_CHARS = 64
LEVELS = 24
#: Code points parsed at once; a single longer text is parsed whole.
SLICE_CHARS = 1 << 19
#: Ranges of keys at most; their bounds are the only thing that the driver gathers.
MOST_RANGES = 1 << 16
RANGE_ROWS = 1000


def _tossed(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 that differ between neighbours, for symbols that do."""
    labels = symbols
    for _ in range(4):
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        before[0] = ~labels[0]
        before[first] = labels[first] ^ labels.dtype.type(1)
        differ = labels ^ before
        place = np.bitwise_count((differ & (~differ + labels.dtype.type(1))) - labels.dtype.type(1))
        bit = (labels >> place.astype(labels.dtype)) & labels.dtype.type(1)
        labels = (place * np.uint8(2) + bit.astype(np.uint8)).astype(np.uint8)
    return labels


def parse(symbols: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, names, text of each name) of the levels from 1 up.

    symbols: the texts' code points end to end. starts: where each text begins,
    and the end.
    """
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for level in range(1, LEVELS + 1):
        if not len(symbols):
            return
        # Runs of one symbol become one.
        fresh = np.ones(len(symbols), bool)
        fresh[1:] = (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(fresh)
        length = np.diff(np.append(at, len(symbols)))
        if len(at) < len(symbols):
            symbols, owner = symbols[at], owner[at]
            repeated = length > 1
            if symbols.dtype != np.uint64:
                symbols = symbols.astype(np.uint64)
            symbols[repeated] = mixed(symbols[repeated] * np.uint64(0x9E3779B97F4A7C15) + length[repeated].astype(np.uint64))
        begins = np.ones(len(symbols), bool)
        begins[1:] = owner[1:] != owner[:-1]
        labels = _tossed(symbols, np.flatnonzero(begins))
        peak = np.zeros(len(labels), bool)
        if len(labels) > 2:
            peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
            peak[:-1] &= ~begins[1:]  # the last symbol of a text is no peak
        cuts = np.flatnonzero(peak | begins)
        sums = prefix_sums(mixed(symbols.astype(np.uint64)))
        names = span_hash(sums, cuts, np.append(cuts[1:], len(symbols)))
        owner = owner[cuts]
        yield level, names, owner
        again = np.bincount(owner, minlength=len(starts) - 1)
        keep = again[owner] > 1
        symbols, owner = names[keep], owner[keep]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of SLOTS bytes for each text; 0 marks an empty slot."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # surrogates can't occur: the texts come from Arrow.
    symbols = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    least = np.full(n * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    short = sizes < SHORT_CHARS
    tops = np.zeros(n, bool)
    for level, names, owner in parse(symbols, starts):
        counts = np.bincount(owner, minlength=n)
        if level >= LOWEST:
            use = slice(None)
        else:  # a text that ends here has just this name
            use = short[owner] | (counts[owner] == 1)
        names, owner = names[use], owner[use]
        tops[owner] = True
        key = owner * SLOTS + (names % np.uint64(SLOTS)).astype(np.int64)
        np.minimum.at(least, key, names >> np.uint64(7))
    out = (least % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    out[least == np.iinfo(np.uint64).max] = 0
    return out.reshape(n, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the slots in use that agree, row by row; 1 where neither has any."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first code points of another."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _place(key, tie: int) -> tuple:
    """Where a row stands; None is the least key."""
    return (0, 0, tie) if key is None else (1, key, tie)


def _ranges(rows: DataFrame, kind: str, range_rows: int) -> tuple[list[tuple], dict[int, tuple[tuple, int]]]:
    """Bounds of the ranges of (key, tie); by range, the place of its greatest row and the next range upwards.

    The bounds come from a sample of at most 4 * MOST_RANGES places, the least by a hash.
    """
    wanted = min(MOST_RANGES, max(1, rows.count() // range_rows))
    bounds: list[tuple] = []
    if wanted > 1:
        sample = rows.select("key", "tie").orderBy(F.xxhash64("key", "tie"), "key", "tie").limit(4 * wanted).collect()
        bounds = sorted({_place(r["key"], r["tie"]) for r in sample})[4::4]
    heads = rows.groupBy(_range_of(bounds)(*_filled(kind)).alias("range")).agg(F.max(F.struct("key", "tie")).alias("head")).collect()
    heads = {r["range"]: _place(r["head"]["key"], r["head"]["tie"]) for r in heads}
    order = sorted(heads)
    return bounds, {b: (heads[b], order[(i + 1) % len(order)]) for i, b in enumerate(order)}


def _filled(kind: str) -> tuple[Column, Column, Column]:
    """Key, whether it is missing, and tie; a missing key has a value, so that whole numbers stay whole in pandas."""
    return F.coalesce("key", F.lit("" if kind == "string" else 0).cast(kind)), F.col("key").isNull(), F.col("tie")


def _places(keys: pd.Series, missing: pd.Series, ties: pd.Series) -> Iterator[tuple]:
    return map(_place, (None if m else k for k, m in zip(keys.tolist(), missing.tolist(), strict=True)), ties.tolist())


def _range_of(bounds: list[tuple]):
    @F.pandas_udf("int")
    def range_of(keys: pd.Series, missing: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, at) for at in _places(keys, missing, ties)], dtype="int32")

    return range_of


def _schema(kind: str) -> str:
    return f"key {kind}, times bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """pairs: (key, text, next text, times). Fingerprints of a run are shared between neighbours."""
    texts, changed, following = [p[1] for p in pairs], [edited(p[1], p[2]) for p in pairs], [p[2] for p in pairs]
    # The next text of a pair is mostly the text of the pair after it.
    chained = [i + 1 < len(pairs) and following[i] is texts[i + 1] for i in range(len(pairs))]
    extra = [t for t, c in zip(following, chained, strict=True) if not c]
    prints = fingerprints(texts + changed + extra)
    n = len(pairs)
    own, new = prints[:n], prints[n : 2 * n]
    place, k = [], 2 * n
    for i, c in enumerate(chained):
        place.append(i + 1 if c else k)
        k += not c
    after = prints[place]
    hexed = lambda rows: [r.tobytes().hex() for r in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p[0] for p in pairs], kind),
            pa.array([p[3] for p in pairs], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(hexed(own)),
            pa.array(hexed(new)),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, after)),
        ],
        names=["key", "times", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (range, ahead, key, copies, text) of whole ranges, each followed by the head of the range below.

    All copies of a row but the last are followed by their own text.
    """
    ready: list[tuple] = []
    size = 0
    kind = pa.null()
    waiting = first = None  # (range, key, copies, text)

    def put(row, following):
        nonlocal size
        _, key, copies, text = row
        if copies > 1:
            ready.append((key, text, text, copies - 1))
        ready.append((key, text, following, 1))
        size += (2 + 2 * (copies > 1)) * len(text) + 1

    for batch in batches:
        kind = batch.schema.field("key").type
        for rng, ahead, key, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if waiting is not None and waiting[0] != rng:
                put(waiting, first[3])  # no head came: the table is this one range
                waiting = None
            if ahead:
                if waiting is not None:
                    put(waiting, text)
                    waiting = None
                continue
            if waiting is not None:
                put(waiting, text)
            else:
                first = (rng, key, copies, text)
            waiting = (rng, key, copies, text)
            if size >= SLICE_CHARS:
                yield _rows(ready, kind)
                ready, size = [], 0
    if waiting is not None:
        put(waiting, first[3])
    if ready:
        yield _rows(ready, kind)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they and the next document's are.

    The next document comes by descending key, the first after the last. Rows are
    dealt by ranges of keys; the head of each range also goes to the range before
    it, so no task needs more than its own ranges, streamed in order. Where keys
    repeat, a range may end within one key's texts, and equal rows are gathered
    into one with a count.
    """
    kind = docs.schema[key].dataType.simpleString()
    sorts = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    rows = docs.select(F.col(key).cast(sorts).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unique = not rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if unique:
        rows = rows.select("key", F.lit(0).cast("long").alias("tie"), F.lit(1).cast("long").alias("copies"), "text")
    else:
        rows = rows.groupBy("key", "text").agg(F.count(F.lit(1)).alias("copies")).select("key", F.xxhash64("text").alias("tie"), "copies", "text")
    bounds, order = _ranges(rows, sorts, range_rows)

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series, missing: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for at in _places(keys, missing, ties):
            own = bisect_right(bounds, at)
            head, target = order[own]
            out.append([own, target] if head == at else [own])
        return pd.Series(out)

    dealt = rows.select("key", "tie", "copies", "text", F.posexplode(places(*_filled(sorts))).alias("ahead", "range"))
    ordered = dealt.repartition("range").sortWithinPartitions("range", "ahead", F.col("key").desc_nulls_last(), F.col("tie").desc(), "text").select("range", "ahead", "key", "copies", "text")
    found = ordered.mapInArrow(released(_walk), _schema(sorts))
    if not unique:
        each = 4096
        parts = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / each)))).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        found = parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(each).cast("long"), F.col("times") - F.col("part") * each))))
    return found.select(F.col("key").cast(kind).alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
