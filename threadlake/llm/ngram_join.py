"""N-gram Jaccard join by vertical partitioning.

Texts become sets of hashed word n-grams; equal sets are one node. One global
order of the n-grams, rare ones first, serves everything: it comes from a count
sketch of fixed size over all texts, so any worker knows it. The join:

1. Every node gives the n-grams of its prefix in that order. Two nodes that link
   share one of them, and their first common one leaves room for the overlap
   that they need, which position and size tell.
2. The nodes of a prefix n-gram are its list. In a list of at most ``SHORT``
   nodes all that have room are candidates. In a longer one they first meet only
   its pivot (the node that has the n-gram earliest). Links found so far make
   components; only nodes of different components are paired after that. A group
   of near copies so costs about as many pairs as it has members, and no link
   between components is lost.
3. Each set has a parity bitmap: a bit for each cell, set if an odd number of its
   n-grams falls there. Bits in which two bitmaps differ are at most as many as
   n-grams in which the sets do, so too many of them rule a pair out for certain.
4. A pair's overlap is counted by vertical partitioning: the order is cut into
   ``FRAGMENTS`` fragments of like mass, each node's set is cut there, partial
   overlaps are counted fragment by fragment and summed per pair.

Long prefix lists are paired block by block, so no task holds a whole list.

Defined cases: a null text, or one without words, has an empty set, links with
nothing and is its own component; a text with fewer words than n is one n-gram;
repeated rows and keys each keep their row; a null key never is a component's
name unless all its keys are null; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.arrow_text import byte_table, mixed, prefix_sums, released, span_hash, text_slices, word_spans
from threadlake.llm.components import components
from threadlake.llm.steps import settled, stored

CELLS, CHUNK = 1 << 20, 1 << 16
FRAGMENTS = 8
#: Bits of a parity bitmap.
PARITY = 512
#: Members of a list that are paired at once, and of a longer list's block.
SHORT, BLOCK = 64, 1024
#: Documents up to which the keys of candidates are broadcast to the scan.
BROADCAST_KEYS = 1_000_000
#: Pairs up to which they are broadcast to what they join, 16 bytes each.
BROADCAST_PAIRS = 1_000_000
#: A text has very many copies if they are more than this part of all rows; there are fewer such texts than that.
HOT = 1024
FAN_IN = 64

_BYTES = byte_table(11)
_BYTES[65:91] = _BYTES[97:123]


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    start, end, row = word_spans(data, offsets)
    words = span_hash(prefix_sums(_BYTES[data]), start, end)
    first = np.searchsorted(row, np.arange(len(offsets)))
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(grams)] + np.uint64(k))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(grams[a : b - n + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + words[k] + np.uint64(0x51 + b - a))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(grams: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


def parity_of(grams: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, as 64-bit words."""
    cells = (grams >> np.uint64(40)).astype(np.int64) % PARITY
    return np.packbits((np.bincount(cells, minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


class Order:
    """The global order of n-grams: by the level of their sketch cell, then by hash."""

    def __init__(self, counts: np.ndarray) -> None:
        self.level = np.minimum(255, np.round(8 * np.log2(1 + counts))).astype(np.uint8)
        mass = np.bincount(self.level, weights=counts, minlength=256)
        self.below = np.concatenate([[0], np.cumsum(mass)])[:256]
        self.mass, self.total = mass, max(1.0, mass.sum())

    def sorted(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams in this order, and their levels. They come sorted by hash."""
        level = self.level[(grams & np.uint64(CELLS - 1)).astype(np.int64)]
        at = np.argsort(level, kind="stable")
        return grams[at], level[at]

    def fragment(self, grams: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Which of FRAGMENTS parts of like mass each n-gram falls into; never falls along the order."""
        part = (self.below[level] + grams.astype(np.float64) / 2.0**64 * self.mass[level]) / self.total
        return np.minimum(FRAGMENTS - 1, (part * FRAGMENTS).astype(np.int64))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"))


def _surveyed(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Rows (key, size, node) of each text, and rows (chunk, counts) of each task's sketch."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "size", "node", "parity", "task", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int32)
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                sets = ngram_sets(data, offsets, n)
                counts += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.int32)
                rows = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), _words([parity_of(s) for s in sets]), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if key_type is not None and counts.any():
            parts = [zlib.compress(counts[c : c + CHUNK].astype(np.int64).tobytes(), 1) for c in range(0, CELLS, CHUNK)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, key_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.array([TaskContext.get().partitionId()] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return settled(_texts(docs, key, text).mapInArrow(released(run), f"key {kind}, size bigint, node bigint, parity array<bigint>, task bigint, chunk int, counts binary"))


def _words(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts)))


def _summed(chunk: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for value in table.column("counts"):
        total += np.frombuffer(zlib.decompress(value.as_py()), np.int64)
    return pa.table({"task": pa.array([chunk[0].as_py()], pa.int64()), "chunk": pa.array([chunk[1].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _order(surveyed: DataFrame) -> Order:
    """Sums the sketches in a tree of fan-in FAN_IN; only the one of fixed size reaches the driver."""
    parts = surveyed.where("chunk is not null").select("task", "chunk", "counts")
    while True:
        most = parts.agg(F.max("task")).first()[0]
        if not most:
            break
        grouped = parts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("long"))
        parts = settled(grouped.groupBy("task", "chunk").applyInArrow(_summed, "task bigint, chunk int, counts binary"))
    counts = np.zeros(CELLS, np.int64)
    for r in parts.collect():
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
    return Order(counts)


def prefix_length(size: int, share: tuple[int, int]) -> int:
    """N-grams of which a set of this size shares one with any set it links to."""
    p, q = share
    return size - -(-p * size // q) + 1


def _entries(docs: DataFrame, key: str, text: str, n: int, order: Order, share: tuple[int, int]) -> DataFrame:
    """(gram, node, spot) of the prefixes; a set that a task has just met is not given again.

    spot: size * 2**32 + position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                columns = [[], [], []]
                for grams in ngram_sets(data, offsets, n):
                    if not len(grams) or (node := node_of(grams)) in met:
                        continue
                    if len(met) > 200_000:
                        met.clear()
                    met.add(node)
                    k = prefix_length(len(grams), share)
                    columns[0].append(order.sorted(grams)[0][:k])
                    columns[1].append(np.full(k, node, np.int64))
                    columns[2].append((len(grams) << 32) + np.arange(k, dtype=np.int64))
                if columns[0]:
                    flat = [np.concatenate(c) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(flat[0].view(np.int64)), *map(pa.array, flat[1:])], names=["gram", "node", "spot"])

    return _texts(docs, key, text).mapInArrow(released(run), "gram bigint, node bigint, spot bigint")


def _has_room(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The same as ``_room`` for pairs of spots."""
    p, q = share
    sa, sb, low = a >> 32, b >> 32, 0xFFFFFFFF
    rest = np.minimum(sa - (a & low), sb - (b & low))
    return (rest * (p + q) >= p * (sa + sb)) & (np.minimum(sa, sb) * q >= np.maximum(sa, sb) * p)


def _listed(entries: DataFrame, share: tuple[int, int], short: int) -> DataFrame:
    """From entries sorted by gram and node: pairs (a, b) with room of short lists, and the long lists' entries.

    A pair's row has no gram. A task holds one list of at most ``short`` nodes
    beside the batch at hand; a longer one passes through.
    """
    names = ["gram", "a", "b"]

    def settle(gram: np.ndarray, node: np.ndarray, spot: np.ndarray, long: bool) -> Iterator[pa.RecordBatch]:
        """Rows of whole lists; ``long``: all are parts of one list that is known to be long."""
        again = np.zeros(len(gram), bool)
        again[1:] = (gram[1:] == gram[:-1]) & (node[1:] == node[:-1])
        gram, node, spot = gram[~again], node[~again], spot[~again]
        if not len(gram):
            return
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        sizes = np.diff(np.append(starts, len(gram)))
        big = np.ones(len(gram), bool) if long else np.repeat(sizes > short, sizes)
        if big.any():
            yield pa.RecordBatch.from_arrays([pa.array(gram[big]), pa.array(node[big]), pa.array(spot[big])], names=names)
        keep = ~big & np.repeat(sizes > 1, sizes)
        gram, node, spot = gram[keep], node[keep], spot[keep]
        left, right = [], []
        for d in range(1, short):
            at = np.flatnonzero(gram[d:] == gram[:-d]) if d < len(gram) else []
            if not len(at):
                break
            at = at[_has_room(spot[at], spot[at + d], share)]
            left.append(node[at])
            right.append(node[at + d])
        if left and len(a := np.concatenate(left)):
            b = np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[0]), pa.array(pairs[1])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        passing = None  # the gram of a long list that isn't over
        for batch in batches:
            gram, node, spot = (np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True))
            if not len(gram):
                continue
            if passing is not None:
                k = int(np.searchsorted(gram != passing, True))
                yield from settle(gram[:k], node[:k], spot[:k], True)
                gram, node, spot = gram[k:], node[k:], spot[k:]
                if not len(gram):
                    rest = [gram, node, spot]
                    continue
                passing = None
            change = np.flatnonzero(gram != gram[-1])
            whole = int(change[-1]) + 1 if len(change) else 0
            yield from settle(gram[:whole], node[:whole], spot[:whole], False)
            tail = [gram[whole:], node[whole:], spot[whole:]]
            if len(np.unique(tail[1])) > short:
                passing = int(gram[-1])
                yield from settle(*tail, True)
                tail = [x[:0] for x in tail]
            rest = tail
        if len(rest[0]):
            yield from settle(*rest, False)

    return entries.mapInArrow(released(run), "gram bigint, a bigint, b bigint")


def _room(a: str, b: str, share: tuple[int, int]) -> Column:
    """Whether sizes and positions of a common n-gram leave the overlap that a link needs."""
    p, q = share
    size = lambda s: F.col(f"{s}size").cast("long")
    rest = F.least(size(a) - F.col(f"{a}pos"), size(b) - F.col(f"{b}pos"))
    return (rest * (p + q) >= p * (size(a) + size(b))) & (F.least(size(a), size(b)) * q >= F.greatest(size(a), size(b)) * p)


def _sent(pairs: DataFrame) -> DataFrame:
    """The pairs, settled, and broadcast where they are few; else the optimizer deals them."""
    pairs = settled(pairs)
    return F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs


def _linked(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps by fragment, summed."""
    p, q = share
    sent = _sent(pairs)
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("asize"), "fragment", F.col("grams").alias("ga")).join(sent, "a")
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("bsize"), "fragment", F.col("grams").alias("gb")).join(sent, "b", "left_semi")
    partial = left.join(right, ["b", "fragment"]).select("a", "b", "asize", "bsize", F.size(F.array_intersect("ga", "gb")).cast("long").alias("common"))
    total = partial.groupBy("a", "b", "asize", "bsize").agg(F.sum("common").alias("common"))
    return total.where(F.col("common") * (p + q) >= p * (F.col("asize") + F.col("bsize"))).select("a", "b")


def _plausible(pairs: DataFrame, marks: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs whose parity bitmaps don't rule them out: marks(node, size, parity)."""
    p, q = share
    side = lambda s: marks.select(F.col("node").alias(s), F.col("size").alias(f"{s}size"), F.col("parity").alias(f"{s}parity"))
    sent = _sent(pairs)
    both = side("a").join(sent, "a").join(side("b").join(sent, "b", "left_semi"), "b")
    differ = F.aggregate(F.zip_with("aparity", "bparity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where(differ * (p + q) <= (F.col("asize") + F.col("bsize")) * (q - p)).select("a", "b")


def _sets(docs: DataFrame, key: str, text: str, n: int, order: Order, nodes: DataFrame, surveyed: DataFrame, unique: bool) -> DataFrame:
    """(node, size, fragment, grams) of the given nodes, and maybe of others, from one text of each.

    unique: no two texts have one key.
    """
    nodes = settled(nodes)
    kept = surveyed.where("chunk is null and size > 0").join(nodes, "node", "left_semi")
    chosen = settled(kept.groupBy("node").agg(F.min("key").alias("key")).select("key").distinct())
    side = chosen.withColumnRenamed("key", "chosen")
    if chosen.count() <= BROADCAST_KEYS:
        side = F.broadcast(side)
    texts = _texts(docs, key, text)
    texts = texts.join(side, F.col("key").eqNullSafe(F.col("chosen")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                nodes, sizes, fragments, parts = [], [], [], []
                for grams in ngram_sets(data, offsets, n):
                    if not len(grams):
                        continue
                    node = node_of(grams)
                    ranked, level = order.sorted(grams)
                    cuts = np.searchsorted(order.fragment(ranked, level), np.arange(FRAGMENTS + 1))
                    for f in range(FRAGMENTS):
                        if cuts[f] < cuts[f + 1]:
                            nodes.append(node)
                            sizes.append(len(grams))
                            fragments.append(f)
                            parts.append(ranked[cuts[f] : cuts[f + 1]].view(np.int64))
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fragments, pa.int32()), _words(parts)], names=["node", "size", "fragment", "grams"])

    found = texts.select("key", "text").mapInArrow(released(run), "node bigint, size int, fragment int, grams array<bigint>")
    return stored(found if unique else found.dropDuplicates(["node", "fragment"]))


def _crossing(entries: DataFrame, share: tuple[int, int], block: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different components that share a prefix n-gram with room.

    The shorter set of a pair needs a smaller prefix, which thins the lists. A list
    of more than ``block`` members is cut into blocks, paired with each other.
    """
    p, q = share
    blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = entries.withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    keyed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("gram", "node", "size", "pos", "component", "pivot", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    side = lambda s: keyed.select("gram", "lo", "hi", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "size", "pos", "component", "pivot", "mine")))
    a, b = side("a"), side("b")
    # a is the longer set, or of equal size the lesser node.
    longer = (F.col("a_size") > F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_node") < F.col("b_node")))
    short = F.col("b_pos") < F.col("b_size") - F.ceil(F.lit(2 * p) * F.col("b_size") / F.lit(p + q)) + 1
    met = ((F.col("a_mine") == F.col("lo")) & (F.col("b_mine") == F.col("hi"))) | ((F.col("a_mine") == F.col("hi")) & (F.col("b_mine") == F.col("lo")))
    fresh = (F.col("a_node") != F.col("a_pivot")) & (F.col("b_node") != F.col("a_pivot"))
    joined = a.join(b, ["gram", "lo", "hi"]).where(longer & short & met & fresh & (F.col("a_component") != F.col("b_component")) & _room("a_", "b_", share))
    return joined.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, share: tuple[int, int] = (90, 100), short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """key, n_shingles and component_id of every row of docs.

    Two texts link when share[1] * intersection >= share[0] * union; a
    component's name is the least key that links reach.
    """
    surveyed = _surveyed(docs, key, text, n)
    order = _order(surveyed)
    found = _entries(docs, key, text, n, order, share)
    sets_of = lambda pairs: _sets(docs, key, text, n, order, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), surveyed, unique)
    kept = surveyed.where("chunk is null")
    unique = not kept.groupBy("key").count().where("count > 1").limit(1).count()
    marks = stored(kept.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("parity").alias("parity")))
    listed = stored(_listed(found.repartition("gram").sortWithinPartitions("gram", "node"), share, short))
    pairs = listed.where("gram is null").select("a", "b")
    entries = listed.where("gram is not null").select("gram", F.col("a").alias("node"), F.shiftright("b", 32).cast("int").alias("size"), F.col("b").bitwiseAND(0xFFFFFFFF).cast("int").alias("pos"))
    heads = entries.groupBy("gram").agg(F.countDistinct("node").alias("members"), F.min(F.struct("pos", "node", "size")).alias("head"))
    # Parts of a long list may repeat a node where they met.
    entries = entries.dropDuplicates(["gram", "node"]).join(heads, "gram").select("gram", "node", "size", "pos", "members", F.col("head.node").alias("p_node"), F.col("head.size").alias("p_size"), F.col("head.pos").alias("p_pos"))
    long_lists = entries.limit(1).count()
    if long_lists:
        entries = settled(entries)
        starred = entries.where("node <> p_node").withColumnsRenamed({"node": "n_node", "size": "n_size", "pos": "n_pos"}).where(_room("n_", "p_", share))
        pairs = pairs.unionByName(starred.select(F.least("n_node", "p_node").alias("a"), F.greatest("n_node", "p_node").alias("b")))
    first_pairs = settled(_plausible(pairs.distinct(), marks, share))
    links = settled(_linked(first_pairs, sets_of(first_pairs), share))
    labels = components(links)
    if long_lists:
        known = settled(entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumnRenamed("p_node", "pivot"))
        open_lists = known.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gram")
        more = settled(_plausible(_crossing(known.join(open_lists, "gram", "left_semi"), share, block), marks, share))
        more_links = settled(_linked(more, sets_of(more), share))
        labels = components(links.unionByName(more_links))
    rows = surveyed.where("chunk is null").select("key", "size", "node")
    named = rows.where("size > 0").groupBy("node").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = settled(named.select("node", "component", "copies").join(least, "component").select("node", "component_id", "copies"))
    # Texts without words have one node in common and need no join. Those with very many copies are at most HOT, and broadcast.
    worded = rows.where("size > 0")
    often = F.col("copies") * HOT > (by_node.agg(F.sum("copies").alias("n")).first()["n"] or 0)
    hot = by_node.where(often).select("node", "component_id")
    rest = worded.join(F.broadcast(hot.select("node")), "node", "left_anti").join(by_node.where(~often).select("node", "component_id"), "node")
    found = worded.join(F.broadcast(hot), "node").unionByName(rest).select("key", "size", "component_id")
    out = found.unionByName(rows.where("size = 0").select("key", "size", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id")


def oracle(table: str, n: int = 3, share: tuple[int, int] = (90, 100)) -> str:
    """DuckDB SQL for the same rows: shared n-grams are counted pair by pair, links followed by recursion."""
    p, q = share
    gram = "concat_ws(' ', " + ", ".join(f"ws[i + {k}]" for k in range(n)) + ")"
    return f"""with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from {table}),
grams as (select distinct doc_id, unnest(case when len(ws) >= {n} then list_transform(range(1, len(ws) - {n - 2}), lambda i: {gram}) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from words),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where {p + q} * c >= {p} * (x.n + y.n)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as x, doc_id as y from {table} union select r.x, e.b from reach r join edges e on e.a = r.y)
select d.doc_id, coalesce(s.n, 0) as n_shingles, m.component_id from {table} d left join sizes s using (doc_id) join (select x, min(y) as component_id from reach group by x) m on m.x = d.doc_id"""
