"""Order-preserving packing of tokenised documents into fixed windows.

The documents of a scan split, in table order, form one stream of tokens. A
dynamic programme over the stream's boundaries (ends of sentences and of
documents) chooses the window cuts: a window that ends at a document costs
nothing more than its padding, one that ends at a sentence a small penalty, and
one that ends inside a sentence, at exactly the window size, a larger one. For
each number m of windows between two boundaries the cost is linear in their
distance, so the best predecessor is the front of a monotone queue. The
programme runs over stretches of bounded length; what a stretch leaves over is
cut into powers of two, which need no padding.

The order is that of the table, and nothing is shuffled: a split is packed where
it is read. sequence_id holds the split above bit 32 and a counter below.

Defined cases: a null or empty text is the end token alone; no token is dropped
or repeated; a text longer than a window is cut; a null key is kept; repeated
rows are packed again; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.arrow_text import released, text_slices
from threadlake.llm import bpe

WINDOW = 1024
#: Tokens that the programme plans at once.
STRETCH = 1 << 17
SENTENCE_PENALTY, BREAK_PENALTY = 1.0, 6.0
#: Windows between two neighbouring chosen boundaries: any number.
MOST_WINDOWS = math.inf
#: Bytes of text that are split into pieces at once.
SPLIT_BYTES = 1 << 24
#: Pieces that one call of the tokenizer gets, whose answer is a list.
CALL_PIECES = 1 << 16
#: Bytes that are a mark of their own, white space of their own, or begin a longer one of either.
_MARKS, _SPACES, _LEADS, _LONG_SPACES = (np.isin(np.arange(256), list(b)) for b in (b".!?\n", b"\t\n\v\f\r \x1c\x1d\x1e\x1f", b"\xe2\xe3\xef", b"\xc2\xe1\xe2\xe3"))


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first three bytes at these places as one number, with zeros behind the end."""
    parts = (np.where(at + k < len(data), data[np.minimum(at + k, len(data) - 1)], 0).astype(np.int64) for k in range(3))
    return next(parts) << 16 | next(parts) << 8 | next(parts)


def sentence_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places after the ends of sentences, of texts in UTF-8 laid end to end.

    An end is a mark before white space or the end of its text, or a full-width stop.
    """
    at = np.flatnonzero((_MARKS | _LEADS)[data])
    lead = data[at]
    wide = at[_LEADS[lead]]
    three = _code_points(data, wide)
    stops = wide[np.isin(three, (0xE38082, 0xEFBC81, 0xEFBC8E, 0xEFBC9F, 0xEFBDA1))] + 3
    ends = np.concatenate([at[_MARKS[lead]] + 1, wide[three == 0xE280A6] + 3])
    last = ends == offsets[np.searchsorted(offsets, ends)]
    ahead = data[np.minimum(ends, len(data) - 1)] if len(data) else lead
    spaced = last | _SPACES[ahead]
    unsure = np.flatnonzero(~spaced & _LONG_SPACES[ahead])
    three = _code_points(data, ends[unsure])
    spaced[unsure] = np.isin(three >> 8, (0xC285, 0xC2A0)) | np.isin(three, (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080))
    return np.sort(np.concatenate([ends[spaced], stops]))


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers.

    A piece is what stands between two single spaces. Many texts are split at
    once, and each different piece is encoded once for all of them.
    """

    def __init__(self, name: str) -> None:
        path = public_tokenizers.path(name)
        self.path = path
        self.vocabulary = bpe.Vocabulary(path)
        self.encode = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(self.vocabulary.ids), special_tokens={}).encode_ordinary
        shown = self.vocabulary.bytes | {i: s.encode() for s, i in self.vocabulary.special.items()}
        self.sizes = np.array([len(shown.get(i, b"")) for i in range(max(shown) + 1)])
        self.whole = None

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), "<u4")

    def _with_care(self, text: str) -> np.ndarray:
        """The ids of a text that holds special strings, or spaces that the next pre-token need not take."""
        if any(s in text for s in self.vocabulary.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return self._joined(bpe.pieces(text))

    def _joined(self, pieces: list[str], by: str = "") -> np.ndarray:
        """The ids of pieces that no pre-token crosses, many in a call, each behind ``by``."""
        calls = (self._plain(by + by.join(pieces[k : k + CALL_PIECES])) for k in range(0, len(pieces), CALL_PIECES))
        return np.concatenate([np.zeros(0, "<u4"), *calls])

    def _spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, each behind a space, and how many each has."""
        ids = self._joined(pieces, " ")
        ends = np.cumsum(pc.binary_length(pa.array(pieces, pa.string())).to_numpy() + np.int64(1))
        return ids, np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1, prepend=0)

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts without nulls: all pieces by number, where each text's begin, and by number the ids and where they begin."""
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, shown = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        head = np.zeros(len(codes), np.bool_)
        head[bounds[:-1]] = True
        used = np.zeros(len(shown), np.bool_)
        used[codes[~head]] = True
        spaced = np.flatnonzero(used)
        sound = np.fromiter((p != "" and not p[0].isspace() for p in shown[spaced]), np.bool_, len(spaced))
        ids, counts = self._spaced(shown[spaced[sound]].tolist())
        # Number 0 has no ids, then come the pieces behind a space, then those that begin a text.
        numbers = np.zeros(len(shown), np.int64)
        numbers[spaced[sound]] = np.arange(1, len(counts) + 1)
        pieces = numbers[codes]
        # Texts in which another piece lies behind a space, or which hold special strings, are encoded by themselves.
        careful = np.zeros(len(texts), np.bool_)
        careful[np.searchsorted(bounds, np.flatnonzero((pieces == 0) & ~head), "right") - 1] = True
        for s in self.vocabulary.special:
            careful |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        firsts, which = np.unique(codes[bounds[:-1]][~careful], return_inverse=True)
        heads = [*map(self._plain, shown[firsts].tolist()), *(self._with_care(texts[k].as_py()) for k in np.flatnonzero(careful).tolist())]
        if careful.any():
            pieces[np.repeat(careful, np.diff(bounds))] = 0
        pieces[bounds[:-1][~careful]] = len(counts) + 1 + which
        pieces[bounds[:-1][careful]] = len(counts) + 1 + len(firsts) + np.arange(np.count_nonzero(careful))
        starts = np.cumsum(np.concatenate([[0, 0], counts, np.array([len(x) for x in heads], np.int64)]))
        return pieces, bounds, np.concatenate([ids, *heads]), starts

    def rows(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text's ids, and token positions after those that end a sentence; a null text has none."""
        texts = texts.fill_null("")
        for first, last, _, _ in text_slices(texts, SPLIT_BYTES):
            part = texts.slice(first, last - first)
            pieces, bounds, known, starts = self._numbered(part)
            for low, high, data, offsets in text_slices(part):
                own = pieces[bounds[low] : bounds[high]]
                start = starts[own]
                stop = np.cumsum(starts[own + 1] - start)
                sizes = np.diff(stop, prepend=0)
                ids = known[np.repeat(start - stop + sizes, sizes) + np.arange(stop[-1])]
                at = np.append(0, stop)[bounds[low : high + 1] - bounds[low]].tolist()
                ends = sentence_ends(data, offsets)
                # A token that holds the end and more is not cut: the boundary is behind it.
                marks = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
                cuts = np.searchsorted(ends, offsets, "right").tolist()
                for k in range(high - low):
                    yield ids[at[k] : at[k + 1]], marks[cuts[k] : cuts[k + 1]] - at[k]

    def parts(self, text: str) -> tuple[list[bytes], np.ndarray]:
        """The ids of one text as bytes, and the positions of ``rows``."""
        ids, marks = next(self.rows(pa.array([text], pa.string())))
        return [ids.tobytes()], marks


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def plan(marks: np.ndarray, penalty: np.ndarray, total: int, window: int = WINDOW) -> list[int]:
    """Ends of the windows of a stretch of ``total`` tokens, the last at ``total``.

    marks: ascending boundaries, the last of them ``total``. penalty: what ending
    a window there costs. best[j] = penalty[j] + min over i before j of best[i] +
    padding + (m - 1) * BREAK_PENALTY, where m * window is the distance rounded
    up. With marks[i] = window * a + r, m is the difference of a, and one more
    where r rises; so the best i is the least of all, at one window more, or the
    least of those with r not below that of j. Of the latter a staircase is kept:
    r and value both rising. A remainder that is a power of two needs no padding.
    """
    spots = np.concatenate([[0], marks]).astype(np.int64)
    n = len(spots)
    turns, phases = np.divmod(spots, window)
    more = window + BREAK_PENALTY
    # What a spot adds to the value of the spot before it: value[j] = best[j] + spots[j] - more * turns[j].
    gains = (np.asarray(penalty, float) - BREAK_PENALTY).tolist()
    halves: dict[int, list[tuple[int, float]]] = {}
    for size in (window // 2, window // 4):
        i = np.searchsorted(spots, spots - size)
        js = np.flatnonzero((spots[i] == spots - size) & (i < np.arange(n)))
        extra = size + 2 + BREAK_PENALTY - more * (turns[js] - turns[i[js]])
        for j, via, by in zip(js.tolist(), i[js].tolist(), extra.tolist(), strict=True):
            halves.setdefault(j, []).append((via, by))
    all_values, came = [0.0] * n, [-1] * n
    # The staircase, with the first spot on it and a step above all spots behind.
    steps, values, who = [0, window], [0.0, math.inf], [0, -1]
    far = more
    for j, r, gain in zip(range(1, n), phases[1:].tolist(), gains, strict=True):
        k = bisect_left(steps, r)
        least, via = values[k], who[k]
        if far <= least:  # the least of all, one window more
            least, via = far, who[0]
        if j in halves:
            for i, by in halves[j]:
                if all_values[i] + by < least:
                    least, via = all_values[i] + by, i
        came[j] = via
        all_values[j] = value = least + gain
        if values[k] <= value:
            continue  # one that reaches as far costs no more
        low = k
        while low and values[low - 1] >= value:
            low -= 1
        high = k + 1 if steps[k] == r else k
        if high == low + 1:
            steps[low], values[low], who[low] = r, value, j
        else:
            steps[low:high], values[low:high], who[low:high] = [r], [value], [j]
        if not low:
            far = value + more
    spots = spots.tolist()
    ends, j = [], n - 1
    while j > 0:
        i = came[j]
        ends.append(spots[j])
        ends.extend(reversed(range(spots[i] + window, spots[j], window)))
        j = i
    return ends[::-1]


class Packer:
    """Feeds documents in order and yields their pieces."""

    def __init__(self, window: int, split: int) -> None:
        self.window, self.sequence = window, split << 32
        self.docs: list[tuple[object, bytes, int]] = []  # key, ids, tokens of the document placed before them
        self.marks: list[np.ndarray] = []
        self.size = 0

    def add(self, key: object, ids: bytes, marks: np.ndarray) -> Iterator[tuple]:
        n = len(ids) // 4
        self.docs.append((key, ids, 0))
        inner = marks[(marks > 0) & (marks < n)] + self.size
        self.marks.append(np.concatenate([inner * 2, [(self.size + n) * 2 + 1]]))  # odd: the end of a document
        self.size += n
        while self.size >= STRETCH:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        """Packs what is there; before the last stretch, the final window waits for more."""
        if not self.size:
            return
        marks = np.unique(np.concatenate(self.marks))
        spots, final = marks >> 1, (marks & 1).astype(bool)
        total = self.size if last else min(self.size, STRETCH)
        keep = spots < total
        spots, final = spots[keep], final[keep]
        spots, final = np.append(spots, total), np.append(final, True)
        ends = plan(spots, np.where(final, 0.0, SENTENCE_PENALTY), total, self.window)
        if last:
            start = ends[-2] if len(ends) > 1 else 0
            ends = ends[:-1]
            rest = total - start
            while rest:  # binary digits of what is left: no padding
                size = min(self.window, 1 << (rest.bit_length() - 1))
                start, rest = start + size, rest - size
                ends.append(start)
        elif len(ends) > 2:
            ends = ends[:-2]
        yield from self._cut(ends)

    def _cut(self, ends: list[int]) -> Iterator[tuple]:
        base, d = 0, 0
        start = 0
        for end in ends:
            offset = 0
            while start < end:
                key, ids, placed = self.docs[d]
                n = len(ids) // 4
                length = min(end, base + n - placed) - start
                at = placed + start - base
                yield key, at, length, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)]), n, self.sequence, offset
                start += length
                offset += length
                if start == base + n - placed:
                    base, d = start, d + 1
            self.sequence += 1
        if d < len(self.docs) and start > base:
            key, ids, placed = self.docs[d]
            self.docs[d] = (key, ids, placed + start - base)
        self.docs = self.docs[d:]
        self.size -= start
        marks = np.concatenate(self.marks)
        marks = marks[marks >> 1 > start] - 2 * start
        self.marks = [marks] if len(marks) else []


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId())
        end = np.array([end_id], "<u4").tobytes()
        pending: list[tuple] = []
        key_type = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*pending, strict=True))
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
            pending.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, (ids, marks) in zip(batch.column(0), tool.rows(batch.column(1)), strict=True):
                pending.extend(packer.add(k.as_py(), ids.tobytes() + end, marks))
                if len(pending) > 20_000:
                    yield out()
        pending.extend(packer.flush(True))
        if pending:
            yield out()

    schema = f"key {kind}, " + ", ".join(f"{n} bigint" for n in names[1:])
    packed = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(released(run), schema)
    return packed.withColumnRenamed("key", key)
