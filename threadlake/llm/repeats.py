"""Removal of repeated passages by distributed prefix doubling.

Every byte goes that a string of ``LENGTH`` bytes covers which also starts
earlier. Positions are compared by ranks of growing prefixes; Spark sorts pairs of
ranks, each round reranks by what follows at a larger offset, and only positions
go on whose rank is still shared, until they are unique or the rank covers LENGTH:

1. Round 0 ranks prefixes of ``START`` bytes. Of the positions in a window of
   LENGTH bytes only the one of least hash stands for it (the leftmost of equals),
   so equal windows are stood for by equal prefixes at equal places, and about one
   position in thirty is sorted. Each position owns a run of windows; a window is
   told by its place, how far the position lies behind its start.
2. A row is (rank, hull): the rank of the bytes that all windows of its range of
   places have in common, and a name of all bytes that the range spans. Sorted by
   both, a rank with one hull is done: unique, or one passage throughout, of which
   all rows but the first are repeats as a whole.
3. What is left is reranked. The range of places is cut so that the common bytes
   grow, by doubling while that is possible: the new rank is that of (rank, rank
   of the bytes at the offset where it ended, before or behind). With 100 and 32
   bytes the rounds reach 66, 95 and 100 bytes, where rank and hull are the same.

A rank only has to tell equal from unequal, so it is a 64-bit name of the pair;
rows count as equal when rank and hull are, 128 bits. Hot passages are thinned
before the shuffle: of equal rows that a task meets, later ones don't leave it.

Order is that of the keys, nulls last, and of equal keys that of the texts'
digests; rows with equal key and text are one document and share its result. Keys
may be of any type that Spark sorts.

Defined cases: a null text is empty; texts below LENGTH bytes lose nothing;
matches never cross texts; strings are judged on the input; repeats may overlap
within a text; a text of any length is read in slices; an empty table gives an
empty result; further columns named in ``carry`` are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.arrow_text import byte_table, mixed, prefix_sums, released, span_hash, text_slices
from threadlake.llm.steps import stored

LENGTH, START = 100, 32
#: Windows that one vectorised step of the scan handles, and rows of one step of a round.
SLICE, ROWS = 1 << 18, 2048
#: Cells into which a round cuts one at most: a passage ends in one of them, and only that is cut further.
PARTS = 6
#: Passages that a task remembers as met.
MET = 1 << 16

_PREFIX, _HULL, _PIECE = byte_table(21), byte_table(22), byte_table(23)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def cells(length: int, start: int) -> list[np.ndarray]:
    """For each round the first places of its cells, and one past the last place at the end.

    The bytes that all windows of a cell have in common double from round to round,
    or the cell is cut into PARTS.
    """
    rounds = [np.array([0, length - start + 1])]
    common = start
    while (rounds[-1][1:] - rounds[-1][:-1]).max() > 1:
        common = min(length, 2 * common)
        most = length - common + 1
        bounds = [0]
        for a, b in zip(rounds[-1][:-1].tolist(), rounds[-1][1:].tolist(), strict=True):
            parts = min(PARTS, -(-(b - a) // most))
            size = -(-(b - a) // parts)
            bounds += [min(b, a + size * (k + 1)) for k in range(-(-(b - a) // size))]
        rounds.append(np.array(bounds))
    return rounds


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the least of the next ``width`` values stands, the leftmost of equals."""
    best, at, have = values.copy(), np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        m = len(values) - step
        if m <= 0:
            break
        # What is read lies ahead of what is written, so both steps may work in place.
        less = best[step:] < best[:m]
        new = best[:m].copy()
        np.copyto(new, best[step:], where=less)
        place = at[:m].copy()
        np.copyto(place, at[step:], where=less)
        best[:m], at[:m] = new, place
        have += step
    return at


def positions(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, start: int = START) -> tuple[np.ndarray, ...]:
    """(rank, hull, text, first window, windows, place of the first) of texts laid end to end."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    if len(data) < length:
        return none
    i = np.arange(len(data) - start + 1)
    prefix = span_hash(prefix_sums(_PREFIX[data]), i, i + start)
    at = _least(prefix, length - start + 1)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    windows = len(data) - length + 1
    whole = np.flatnonzero(text[:windows] == text[length - 1 :])
    if not len(whole):
        return none
    owner = at[whole].astype(np.int64)
    fresh = np.ones(len(whole), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (text[whole[1:]] != text[whole[:-1]])
    first = np.flatnonzero(fresh)
    lo, hi, owner = whole[first], whole[np.append(first[1:], len(whole)) - 1], owner[first]
    rank = prefix[owner]
    del prefix, at
    n, place = hi - lo + 1, owner - lo
    hull = span_hash(prefix_sums(_HULL[data]), lo, hi + length) ^ _shape(n, place)
    return rank, hull, text[lo].astype(np.int64), lo - offsets[text[lo]], n, place


def _shape(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mixed((place * 65_536 + n).astype(np.uint64))


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes that precede, bytes, offsets) of slices; long texts come in several.

    Slices of one text overlap by length - 1 bytes, so each window is in one of them.
    """
    for row, end, data, offsets in text_slices(column, SLICE):
        if end - row > 1 or len(data) <= SLICE + length:
            yield row, end, 0, data, offsets
            continue
        for a in range(0, len(data) - length + 1, SLICE):
            part = data[a : a + SLICE + length - 1]
            yield row, end, a, part, np.array([0, len(part)])


class _Met:
    """Passages that a task has met more than once, each with the key of a row that it gave out."""

    def __init__(self) -> None:
        self.names, self.keys = np.zeros(0, np.uint64), None

    def later(self, names: np.ndarray, keys: pa.Array) -> np.ndarray:
        """Whether a row is a repeat of one that was given out, because that one's key is less."""
        out = np.zeros(len(names), bool)
        if len(self.names) and len(names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            same = np.flatnonzero(self.names[at] == names)
            if len(same):
                out[same] = pc.fill_null(pc.greater(keys.take(pa.array(same)), self.keys.take(pa.array(at[same]))), False).to_numpy(zero_copy_only=False)
        return out

    def add(self, names: np.ndarray, keys: pa.Array) -> None:
        fresh = np.flatnonzero(~np.isin(names, self.names) & keys.is_valid().to_numpy(zero_copy_only=False))
        if not len(fresh):
            return
        _, once = np.unique(names[fresh], return_index=True)
        fresh = fresh[once]
        if len(self.names) + len(fresh) > MET:
            self.names, self.keys = np.zeros(0, np.uint64), None
            fresh = fresh[:MET]
        new = keys.take(pa.array(fresh))
        joined = np.concatenate([self.names, names[fresh]])
        order = np.argsort(joined)
        self.names = joined[order]
        self.keys = (pa.concat_arrays([self.keys, new]) if self.keys is not None else new).take(pa.array(order))


def _packed(lo: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (lo.astype(np.int64) << 32) | (n.astype(np.int64) << 16) | place.astype(np.int64)


def _merged(row: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by row and lo, of which those that touch become one."""
    if not len(row):
        return row, lo, end
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > end[:-1])
    first = np.flatnonzero(new)
    return row[first], lo[first], end[np.append(first[1:], len(row)) - 1]


def _scan(rows: DataFrame, ids: list[str], length: int, start: int) -> DataFrame:
    """Rows (rank, hull, ids, at); where hull is null, a span that is known to repeat: at as start * 2**32 + end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in batches:
            table = batch.select(ids)
            for row, end, before, data, offsets in _pieces(batch.column(len(ids)), length):
                rank, hull, text, lo, n, place = positions(data, offsets, length, start)
                if not len(rank):
                    continue
                lo = lo + before
                part = table.slice(row, end - row)
                order = pc.sort_indices(pa.Table.from_batches([part]), [(k, "ascending") for k in ids], null_placement="at_end").to_numpy()
                nth = np.empty(end - row, np.int64)
                nth[order] = np.arange(end - row)
                # Equal rows of this slice: the first stays, the others are repeats.
                at = np.lexsort((lo, nth[text], hull, rank))
                again = np.zeros(len(at), bool)
                again[1:] = (rank[at[1:]] == rank[at[:-1]]) & (hull[at[1:]] == hull[at[:-1]])
                known = np.zeros(len(at), bool)
                known[at] = again
                keys = part.column(0)
                name = mixed(rank) ^ hull
                firsts = at[np.flatnonzero(again & ~np.concatenate([[False], again[:-1]])) - 1]
                open_rows = np.flatnonzero(~known)
                known[open_rows] = met.later(name[open_rows], keys.take(pa.array(text[open_rows])))
                met.add(name[firsts], keys.take(pa.array(text[firsts])))
                t, a, z = _merged(text[known], lo[known], (lo + n - 1 + length)[known])
                kept = np.flatnonzero(~known)
                who = part.take(pa.array(np.concatenate([text[kept], t])))
                gaps = len(t)
                spot = np.concatenate([_packed(lo[kept], n[kept], place[kept]), (a << 32) | z])
                ranks = np.concatenate([rank[kept], mixed(spot[len(kept) :].view(np.uint64) + np.uint64(row + 1))])
                hulls = pa.array(np.concatenate([hull[kept].view(np.int64), np.zeros(gaps, np.int64)]), mask=np.arange(len(ranks)) >= len(kept))
                yield pa.RecordBatch.from_arrays([pa.array(ranks.view(np.int64)), hulls, *who.columns, pa.array(spot)], names=["rank", "hull", *ids, "at"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ids)
    return rows.select(*ids, "text").mapInArrow(released(run), f"rank bigint, hull bigint, {kinds}, at bigint")


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans laid end to end, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def reranked(rank: np.ndarray, at: np.ndarray, data: np.ndarray, begin: np.ndarray, length: int, now: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, ...]:
    """(parent, rank, hull, at, begin, size) of rows whose places are cut from the cells ``now`` into those of ``then``.

    begin: where in data the bytes of a row's windows start.
    """
    lo, n, place = at >> 32, (at >> 16) & 0xFFFF, at & 0xFFFF
    low = place - n + 1
    first, last = (np.searchsorted(then, x, "right") - 1 for x in (low, place))
    counts = last - first + 1
    parent = np.repeat(np.arange(len(rank)), counts)
    cell = first[parent] + np.arange(len(parent)) - np.repeat(np.cumsum(counts) - counts, counts)
    above = np.searchsorted(now, then[cell], "right") - 1
    x, y = np.maximum(then[cell], low[parent]), np.minimum(then[cell + 1] - 1, place[parent])
    skip = place[parent] - y
    anchor = begin[parent] + place[parent]
    sums = prefix_sums(_PIECE[data])
    before = span_hash(sums, anchor - then[cell], anchor - now[above])
    behind = span_hash(sums, anchor + length - now[above + 1] + 1, anchor + length - then[cell + 1] + 1)
    new = mixed(mixed(rank[parent] * _FACTOR + before) * _FACTOR + behind + cell.astype(np.uint64))
    count, start = y - x + 1, begin[parent] + skip
    size = count - 1 + length
    hull = span_hash(prefix_sums(_HULL[data]), start, start + size) ^ _shape(count, y)
    return parent, new, hull, _packed(lo[parent] + skip, count, y), start, size


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and where each row's begin and end."""
    buffers, wide = column.buffers(), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _batch(ids: list[str], who: list[pa.Array], rank: np.ndarray, hull: np.ndarray, at: np.ndarray, done: np.ndarray, parts: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    if parts is None:
        bytes_ = pa.nulls(len(rank), pa.binary())
    else:
        bytes_ = pa.Array.from_buffers(pa.binary(), len(rank), [None, pa.py_buffer(parts[1].astype(np.int32).tobytes()), pa.py_buffer(parts[0].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(hull.view(np.int64)), *who, pa.array(at), pa.array(done), bytes_], names=["rank", "hull", *ids, "at", "done", "bytes"])


def _first_round(ids: list[str], length: int, now: np.ndarray, then: np.ndarray):
    """Rows (ids, text, wanted) to the rows of the next round, with the bytes of their windows."""
    last = len(then) - 1 == then[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _flat(batch.column("text"))
            lists = batch.column("wanted")
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            rank, at = (np.asarray(flat.field(k)) for k in ("rank", "at"))
            for k in range(0, len(rank), ROWS):
                r, here, doc = rank[k : k + ROWS].view(np.uint64), at[k : k + ROWS], row[k : k + ROWS]
                part, begin = _gathered(data, offsets[doc] + (here >> 32), ((here >> 16) & 0xFFFF) - 1 + length)
                parent, new, hull, spot, start, size = reranked(r, here, part, begin[:-1], length, now, then)
                take = pa.array(doc[parent])
                yield _batch(ids, [batch.column(c).take(take) for c in ids], new, hull, spot, np.zeros(len(new), bool), None if last else _gathered(part, start, size))

    return released(run)


def _next_round(ids: list[str], length: int, now: np.ndarray, then: np.ndarray):
    """Rows of a round to those of the next; those that are done stay as they are."""
    last = len(then) - 1 == then[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                done = part.column("done").to_numpy(zero_copy_only=False)
                over, going = part.filter(pa.array(done)), part.filter(pa.array(~done))
                if over.num_rows:
                    yield _batch(ids, [over.column(c) for c in ids], over.column("rank").to_numpy().view(np.uint64), over.column("hull").to_numpy().view(np.uint64), over.column("at").to_numpy(), np.ones(over.num_rows, bool), None)
                if going.num_rows:
                    data, offsets = _flat(going.column("bytes"))
                    parent, new, hull, spot, start, size = reranked(going.column("rank").to_numpy().view(np.uint64), going.column("at").to_numpy(), data, offsets[:-1], length, now, then)
                    take = pa.array(parent)
                    yield _batch(ids, [going.column(c).take(take) for c in ids], new, hull, spot, np.zeros(len(new), bool), None if last else _gathered(data, start, size))

    return released(run)


def _cutter(names: list[str], as_text: bool):
    """Rows (..., text, spans) to (..., n_bytes, n_removed, n_spans, kept); spans are start * 2**32 + end and may overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, kept, removed, counts = [], [], [], []
                for data, spans in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("spans"), strict=True):
                    n = runs = 0
                    sizes.append(len(data))
                    if spans.is_valid and len(spans.values):
                        x = np.sort(spans.values.to_numpy())
                        lo, end = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
                        new = np.concatenate([[True], lo[1:] > end[:-1]])
                        starts, ends = lo[new], end[np.append(np.flatnonzero(new)[1:], len(x)) - 1]
                        edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), len(data)]
                        parts = [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                        data = "".join(p.decode(errors="ignore") for p in parts).encode() if as_text else b"".join(parts)
                        n, runs = int((ends - starts).sum()), len(starts)
                    kept.append(data)
                    removed.append(n)
                    counts.append(runs)
                values = pa.array(kept, pa.binary())
                whole = [pa.array(x, pa.int64()) for x in (sizes, removed, counts)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *whole, values.cast(pa.string()) if as_text else values], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return released(run)


def _is_unique(rows: DataFrame) -> bool:
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return not counts.where("n > 1 or key is null").limit(1).count()


def _uid(kind: str, unique: bool) -> Column:
    """What tells documents apart and is never null: the key itself, or a digest of key and text."""
    if unique:
        empty = {"string": ""}.get(kind, 0)
        return F.coalesce(F.col("key"), F.lit(empty).cast(kind))
    return F.coalesce(F.sha2(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("\x00"), F.col("key").isNull().cast("string"), F.lit("\x00"), F.col("text")), 256), F.lit(""))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, start: int = START, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (the remaining bytes) and the carried columns of every row.

    as_text: kept is a string, without the characters that were cut through.
    """
    kind = docs.schema[key].dataType.simpleString()
    carried = [f"carry_{i}" for i in range(len(carry))]
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(c).alias(x) for c, x in zip(carry, carried, strict=True)))
    unique = kind in ("tinyint", "smallint", "int", "bigint", "string") and _is_unique(rows)
    rows = rows.withColumn("uid", _uid(kind, unique))
    ids = ["uid"] if unique else ["key", "uid"]
    # Rows that are one document must not be each other's repeats.
    once = rows if unique else rows.dropDuplicates(["uid"])
    rounds = cells(length, start)
    rounds += rounds[-1:] * (len(rounds) == 1)
    scanned = _scan(once, ids, length, start)
    in_order = [F.col(k).asc_nulls_last() for k in ids] + [F.col("at")]

    def ranked(frame: DataFrame) -> DataFrame:
        """With ``again``, whether an equal row comes earlier, and ``kinds``, how many hulls share the rank."""
        dealt = frame.repartition("rank").withColumn("again", F.row_number().over(Window.partitionBy("rank", "hull").orderBy(*in_order)) > 1)
        return dealt.withColumn("kinds", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(Window.partitionBy("rank")))

    windows = F.shiftright("at", 16).bitwiseAND(0xFFFF)
    span = (F.shiftleft(F.shiftright("at", 32), 32) + F.shiftright("at", 32) + windows + (length - 1))
    first = ranked(scanned).where("hull is null or again or kinds > 1")
    over = F.col("hull").isNull() | F.col("again")
    first = stored(first.select(F.when(~over, F.col("rank")).alias("rank"), *ids, F.when(F.col("hull").isNull() | ~F.col("again"), F.col("at")).otherwise(span).alias("at")))
    wanted = first.where("rank is not null").groupBy("uid").agg(F.collect_list(F.struct("rank", "at")).alias("wanted"))
    shape = ", ".join(["rank bigint, hull bigint", *(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ids), "at bigint, done boolean, bytes binary"])
    # The texts meet their positions and later their spans in one and the same shuffle.
    texts = rows.join(wanted, "uid").select(*rows.columns, "wanted")
    going = (texts if unique else texts.dropDuplicates(["uid"])).mapInArrow(_first_round(ids, length, rounds[0], rounds[1]), shape)
    for now, then in zip(rounds[1:], [*rounds[2:], None], strict=True):
        # A row that is done is only passed on, under a rank of its own.
        going = ranked(going).where("done or again or kinds > 1").withColumn("done", F.col("done") | F.col("again"))
        if then is not None:
            going = going.withColumn("rank", F.when(F.col("done"), F.xxhash64("uid", "at")).otherwise(F.col("rank"))).withColumn("hull", F.when(F.col("done"), F.lit(0).cast("long")).otherwise(F.col("hull")))
            going = going.select("rank", "hull", *ids, "at", "done", "bytes").mapInArrow(_next_round(ids, length, now, then), shape)
    repeats = first.where("rank is null").select("uid", F.col("at").alias("span")).unionByName(going.where("done").select("uid", span.alias("span")))
    spans = repeats.groupBy("uid").agg(F.collect_list("span").alias("spans"))
    joined = rows.join(spans, "uid", "left").select("key", *carried, "text", "spans")
    out = ", ".join([f"key {kind}", *(f"{x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(carry, carried, strict=True)), "n_bytes bigint, n_removed bigint, n_spans bigint", f"kept {'string' if as_text else 'binary'}"])
    cut = joined.mapInArrow(_cutter(["key", *carried], as_text), out)
    return cut.select(F.col("key").alias(key), "n_bytes", "n_removed", "n_spans", "kept", *(F.col(x).alias(c) for c, x in zip(carry, carried, strict=True)))


def oracle(table: str, length: int = LENGTH) -> str:
    """DuckDB SQL for key, n_bytes, n_removed, n_spans and kept_sha256, over hexadecimal digits; every window is a row."""
    return f"""with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from {table}),
windows as (select doc_id, h, unnest(range(0, len(h) // 2 - {length - 1})) as i from docs),
hashed as (select doc_id, i, hash(substring(h, 2 * i + 1, {2 * length})) as w from windows),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by w order by doc_id, i) as nth from hashed) where nth > 1),
marked as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + {length} then 0 else 1 end as starts from later),
runs as (select doc_id, min(i) as a, max(i) + {length} as z from (select *, sum(starts) over (partition by doc_id order by i) as run from marked) group by doc_id, run),
gaps as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as a, a as z from runs union all select d.doc_id, coalesce(max(r.z), 0), len(any_value(d.h)) // 2 from docs d left join runs r using (doc_id) group by d.doc_id),
kept as (select g.doc_id, string_agg(substring(d.h, 2 * g.a + 1, 2 * (g.z - g.a)), '' order by g.a) as h from gaps g join docs d using (doc_id) group by g.doc_id),
sums as (select doc_id, cast(sum(z - a) as bigint) as n_removed, count(*) as n_spans from runs group by doc_id)
select d.doc_id, len(d.h) // 2 as n_bytes, coalesce(s.n_removed, 0) as n_removed, coalesce(s.n_spans, 0) as n_spans, sha256(unhex(k.h)) as kept_sha256 from docs d join kept k using (doc_id) left join sums s using (doc_id)"""
