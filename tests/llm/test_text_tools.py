"""Tokens, packing, mixing, fingerprints, media and toxicity against plain versions."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadlake.llm import bpe, fingerprints, media, mixing, packing, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int"
ODD = ["", None, "a", "  two  spaces ", "x\n\n y\t", "<|endoftext|> in <|endoftext|>text", "日本語 テキスト", "word " * 3000, "é" * 500, "\x00\x1c z", "DON'T we'll 12,345.67 !!", "same", "same"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter("byte_bpe_50k.json")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 4 else None, None, "clash", 1) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("text", [t or "" for t in ODD])
def test_counts_equal_the_library(counter, library, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_counts_of_any_text(counter, library, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_is_counted(counter, library):
    word = " incomprehensibilities"
    counts, _ = counter.prefixes(word.encode())
    assert counts == [len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(len(word) + 1)]
    text = "Some words, and 123 numbers."
    for budget in (0, 1, 3, 5, 100):
        ids = library.encode(text, add_special_tokens=False).ids[:budget]
        assert text.encode()[: counter.fitting_bytes(text, budget)].decode() == library.decode(ids)
    assert counter.prefix_count(text, 9) == len(library.encode(text[:9], add_special_tokens=False).ids)


def test_small_memo_changes_nothing(library):
    small = bpe.PrefixCounter(bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN, memo=4)
    text = "one two three four five six one two three " * 5
    assert small.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_count_table(spark, library):
    rows = token_counts.count_tokens(docs_of(spark, ODD)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(ODD)}
    assert token_counts.count_tokens(docs_of(spark, ODD).limit(0)).count() == 0


def check_pieces(rows, texts, library, window=1024):
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, want in ids.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(want)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / sum(map(len, ids.values()))


def test_packing(spark, library):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta.", "gamma,", "delta"]) for _ in range(rng.randint(1, 900))) for _ in range(120)]
    assert check_pieces(packing.pack(docs_of(spark, texts)).collect(), texts, library) < 0.05
    assert packing.pack(docs_of(spark, texts).limit(0)).count() == 0


def plain_sentence_ends(text):
    """Byte positions after marks that white space or the end follows, and after full-width stops."""
    out = []
    for i, c in enumerate(text):
        ahead = text[i + 1 : i + 2]
        if c in "\u3002\uff01\uff0e\uff1f\uff61" or c in ".!?\n\u2026" and (not ahead or ahead.isspace()):
            out.append(len(text[: i + 1].encode()))
    return out


PIECES = st.sampled_from([".", "!", "\n", "\u2026", "\u3002", "\uff01", "\uff71", "\uff61", " ", "  ", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u200b", "\u2028", "\u205f", "\u3000", "\u3001", "a", "word", "\xe9", "\u672c", "<|endoftext|>", "'s", "12"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(PIECES, max_size=12).map("".join) | st.text(max_size=12), max_size=8), st.sampled_from([1, 40, 1 << 24]), st.sampled_from([1, 3, 1 << 16]))
def test_many_texts_at_once(library, texts, split, calls):
    tool = packing.encoder("byte_bpe_50k.json")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "SPLIT_BYTES", split)
        patch.setattr(packing, "CALL_PIECES", calls)
        found = list(tool.rows(pa.array(texts, pa.string())))
    assert len(found) == len(texts)
    for t, (ids, marks) in zip(texts, found, strict=True):
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids
        reach = np.cumsum(tool.sizes[ids]).tolist()
        assert marks.tolist() == [next(k for k, x in enumerate(reach, 1) if x >= end) for end in plain_sentence_ends(t or "")]


def test_a_piece_is_encoded_once_for_many_texts(library, monkeypatch):
    tool, seen = packing.encoder("byte_bpe_50k.json"), []
    encode = tool.encode
    monkeypatch.setattr(tool, "encode", lambda text: seen.append(text) or encode(text))
    texts = [f"{'One' if i % 2 else 'Two'} more rare{i % 7}, never before qxj{i % 50}." for i in range(400)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = [ids.tolist() for ids, _ in tool.rows(pa.array(texts))]
    assert got == want
    # One call for each way to begin a text, one for all that comes later.
    assert len(seen) <= 3 and sum(map(len, seen)) < 1000


def best_cost(marks, penalty, window):
    """The programme's optimum by trying every predecessor."""
    spots, costs = [0, *marks], [0.0, *penalty]
    best = [0.0]
    for j in range(1, len(spots)):
        options = []
        for i in range(j):
            gap = spots[j] - spots[i]
            m = -(-gap // window)
            if m <= packing.MOST_WINDOWS:
                options.append(best[i] + m * window - gap + (m - 1) * packing.BREAK_PENALTY)
            if gap in (window // 2, window // 4):
                options.append(best[i] + 2)
        gap = spots[j] - spots[j - 1]
        best.append((min(options) if options else best[j - 1] + -gap % window + (gap - 1) // window * packing.BREAK_PENALTY) + costs[j])
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.randoms())
def test_plan_is_optimal(gaps, rng):
    window = 64
    marks = np.cumsum(gaps)
    penalty = np.array([rng.choice((0.0, 1.0)) for _ in marks])
    ends = packing.plan(marks, penalty, int(marks[-1]), window)
    assert ends == sorted(set(ends)) and ends[-1] == marks[-1]
    cost, start, at = 0.0, 0, dict(zip(marks.tolist(), penalty.tolist(), strict=True))
    for end in ends:
        assert end - start <= window
        short = end - start in (window // 2, window // 4) and end in at
        cost += min(2.0, window - (end - start)) if short else window - (end - start)
        cost += at[end] if end in at else packing.BREAK_PENALTY
        start = end
    assert cost <= best_cost(marks.tolist(), penalty.tolist(), window) + 1e-6 + 2.0 * len(ends) * 0


def test_pivot_keeps_the_sum_and_the_odds():
    size = np.array([3.0, 10.0, 4.0, 7.0, 1.0, 9.0])
    total = np.zeros(6)
    for seed in range(3000):
        draw = mixing._draws(np.arange(6) + 1000 * seed, seed)
        out, left = mixing.pivot(size * 0.4, size, draw)
        assert out.sum() == pytest.approx((size * 0.4).sum())
        assert all(x in (0.0, s) for i, (x, s) in enumerate(zip(out, size, strict=True)) if i != left)
        total += out
    assert np.allclose(total / 3000 / size, 0.4, atol=0.04)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e12
    goal = 1.5 * sum(sizes.values())
    for _ in range(300):
        mid = (low + high) / 2
        if sum(min(2 * sizes[s], mid * weight[s]) for s in names) < goal:
            low = mid
        else:
            high = mid
    return {s: min(2 * sizes[s], high * weight[s]) for s in names}


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 40)), "en", rng.choice(["a", "a", "a", "b", "c", "d", None]), None, "k", 0) for i in range(900)] + [(1000, None, "en", "e", None, "k", 0), (1, "same same", "en", "a", None, "k", 0), (1, "same same", "en", "a", None, "k", 0), (None, "x", "en", "b", None, "k", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs, block=32).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    targets, taken = plain_targets(sizes), collections.Counter()
    for r in out:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["part"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    assert sum(r["part"] > 0 for r in out) <= len(sizes)
    again = mixing.mix(docs.repartition(3), block=32)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_fingerprints_of_shifted_text():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(600))
    other = "".join(rng.sample(text, len(text)))
    a, shifted, cut, b, twin = fingerprints.fingerprints([text, "some prefix " + text, text[:2500], other, text])
    like = lambda x, y: fingerprints.likeness(x[None], y[None])[0]
    assert like(a, twin) == 1 and like(a, shifted) > 0.8 and like(a, cut) > 0.5 and like(a, b) < 0.2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=50), max_size=6))
def test_fingerprints_alone_or_together(texts):
    together = fingerprints.fingerprints(texts)
    for t, f in zip(texts, together, strict=True):
        assert np.array_equal(fingerprints.fingerprints([t])[0], f)
        assert (f.any()) == bool(t)


MASK = (1 << 64) - 1
GOLD = 0x9E3779B97F4A7C15


def plain_mixed(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def plain_fingerprint(text):
    """Slots of one text, symbol by symbol."""
    symbols, least, level = [ord(c) for c in text], {}, 0
    while symbols and level < fingerprints.LEVELS:
        level += 1
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        symbols = [plain_mixed((s * GOLD + n) & MASK) if n > 1 else s for s, n in runs]
        labels = symbols
        for _ in range(4):
            before = [labels[0] ^ 1, *labels[:-1]]
            places = [((x ^ y) & -(x ^ y)).bit_length() - 1 for x, y in zip(labels, before, strict=True)]
            labels = [2 * p + (x >> p & 1) for x, p in zip(labels, places, strict=True)]
        cuts = [0] + [i for i in range(1, len(labels) - 1) if labels[i - 1] < labels[i] > labels[i + 1]]
        names = []
        for i, j in zip(cuts, [*cuts[1:], len(symbols)], strict=True):
            total = sum(plain_mixed(s) * pow(GOLD, k, 1 << 64) for k, s in enumerate(symbols[i:j]))
            names.append(plain_mixed((total + j - i) & MASK))
        if level >= fingerprints.LOWEST or len(text) < fingerprints.SHORT_CHARS or len(names) == 1:
            for x in names:
                least[x % 128] = min(least.get(x % 128, MASK), x >> 7)
        symbols = names if len(names) > 1 else []
    return bytes(least[k] % 255 + 1 if k in least else 0 for k in range(128))


def plain_likeness(a, b):
    used = sum(x > 0 or y > 0 for x, y in zip(a, b, strict=True))
    return sum(x == y > 0 for x, y in zip(a, b, strict=True)) / used if used else 1.0


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_fingerprint_table(spark, n):
    texts = [ODD[i % len(ODD)] if i % 3 else f"text number {i} " * i for i in range(n)]
    texts = [t[:3000] if t else t for t in texts]
    rows = fingerprints.fingerprint_documents(docs_of(spark, texts), range_rows=5).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(n))
    for r in rows:
        own, after = texts[r["doc_id"]] or "", texts[(r["doc_id"] - 1) % n] or ""
        k = len(own) // 3
        changed = own[: len(own) - k] + after[:k]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        own_print, new, following = map(plain_fingerprint, (own, changed, after))
        assert r["fingerprint"] == own_print.hex() and r["edited_fingerprint"] == new.hex()
        assert r["near_next"] == pytest.approx(plain_likeness(own_print, following)) and r["near_edited"] == pytest.approx(plain_likeness(own_print, new))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_of_repeated_and_null_keys(spark, kind):
    big = 1 << 60
    rows = [(None, "lost"), (None, "lost"), (None, "gone and lost"), (None, None), (big + 1, "first"), (big, "second"), (7, "x" * 50), (7, "x" * 50), (7, "y" * 50)] + [(None, "lost")] * 5
    rows = [(k if k is None or kind == "long" else f"{k:020}", t) for k, t in rows]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    for size in (1, 1000):
        got = fingerprints.fingerprint_documents(docs, range_rows=size).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(k), len(t or "")) for k, t in rows)
        after = {}
        for r in got:
            after.setdefault((r["doc_id"], r["n_chars"]), []).append(r["edited_sha256"])
        edit = lambda own, following: hashlib.sha256(fingerprints.edited(own, following).encode()).hexdigest()
        first = rows[4][0]
        assert after[first, 5] == [edit("first", "second")]
        assert len(after[None, 4]) == 7 and after[None, 4].count(edit("lost", "lost")) >= 6


def plain_feature(samples):
    """Mean, spread and zeros, and of 8 bands of rows and 8 of columns, which lie above the mean of all."""
    n = len(samples) // 64
    cell = lambda i, j: [samples[r * 64 + c] for r in range(int(i * n / 8), max(int((i + 1) * n / 8), int(i * n / 8) + 1)) if r < n for c in range(8 * j, 8 * j + 8)]
    mean = lambda x: sum(x) / len(x) if x else 0.0
    cells = [mean(cell(i, j)) for i in range(8) for j in range(8)]
    bits = "".join("1" if c > mean(cells) else "0" for c in cells)
    m = mean(samples)
    return f"mean={m:.4f};std={mean([(x - m) ** 2 for x in samples]) ** 0.5:.4f};zero={samples.count(0) / len(samples):.4f};ahash={int(bits, 2):016x}"


def test_media(spark):
    docs = docs_of(spark, ODD)
    rows = media.media_digests(docs).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        data = (ODD[r["doc_id"]] or "").encode()
        full = media.padded(data)
        assert len(full) % 64 == 0 and len(full) > 0 and full.startswith(data)
        stored = media.store_image(full, len(data))
        assert media.read_image(stored) == (full, len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(full), hashlib.sha256(full).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(full[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert len(full) > 64_000 or r["feature"] == plain_feature(full)


def test_media_of_repeated_rows_and_hot_digests(spark):
    rows = [(i % 3 if i % 5 else None, "same" if i % 2 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((str(k), len(t or "")) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in media.media_digests(docs).collect()) == want
    sequences = media.parse_sequences(media.pages_of_texts(docs, "doc_id", "text"), "doc_id", "html")
    for hot, most in ((1, 0), (3, 100)):
        found = media.describe_media(media.resolve_media(sequences, media.media_of_texts(docs, "text"), hot, most)).collect()
        assert sorted(r["media"]["n_bytes"] for r in found) == sorted(n for _, n in want)
    assert media.media_digests(docs.limit(0)).count() == 0


def test_sequences_stay_aligned(spark):
    html = '<p>one</p><img src="sha256:d1" alt="A"><p>two <b>bold</b></p><figure><img src="sha256:none"><img src="sha256:d2"><figcaption>Cap &amp; tion</figcaption></figure><script>x</script><p>three'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (1, "<p>again</p>")], "page_id long, html string")
    sequences = media.parse_sequences(pages, "page_id", "html")
    items = next(r["items"] for r in sequences.collect() if len(r["items"]) > 1)
    assert [(i["position"], i["kind"], i["text"] or i["digest"], i["caption"]) for i in items] == [(0, "text", "one", None), (1, "img", "d1", "A"), (2, "text", "two bold", None), (3, "img", "none", "Cap & tion"), (4, "img", "d2", "Cap & tion"), (5, "text", "three", None)]
    table = spark.createDataFrame([("d1", bytearray(media.store_image(bytes(64), 1))), ("d2", bytearray(media.store_image(bytes(64), 2))), ("d2", bytearray(media.store_image(bytes(64), 2)))], "digest string, payload binary")
    resolved = media.resolve_media(sequences, table)
    whole = sorted(media.sequences_with_media(sequences, resolved, "page_id").collect(), key=lambda r: (r["page_id"], -len(r["items"])))
    assert [(r["page_id"], len(r["items"])) for r in whole] == [(1, 6), (1, 1), (2, 0), (3, 0)]
    assert [i["payload"] and media.read_image(bytes(i["payload"]))[1] for i in whole[0]["items"]] == [None, 1, None, None, 2, None]
    described = media.sequences_with_media(sequences, media.describe_media(resolved), "page_id", "media").collect()
    items = max((r["items"] for r in described), key=len)
    assert [(i["caption"], i["media"] and i["media"]["n_bytes"]) for i in items] == [(None, None), ("A", 1), (None, None), ("Cap & tion", None), ("Cap & tion", 2), (None, None)]
    with pytest.raises(ValueError):
        media.read_image(b"P6\n64 1\n255\n" + bytes(64))


def plain_matches(model, clause):
    """What a clause says, read word by word with looks backwards instead of states."""
    words = toxicity.WORD.findall(clause)
    kinds = [model.classes.get(w) or ("insult" if model.weight(w) else "other") for w in words]
    out, last, used = [], "", -1

    def meant(i):
        """Whether somebody is spoken to or of at word i; "is" takes no word off the reach."""
        left, named = 0, 0
        for k in kinds[:i]:
            if k == "you":
                left, named = toxicity.AIM, 0
            elif k == "be" and named:
                left, named = toxicity.AIM, 0
            elif k == "they" and left <= 1:
                left, named = 0, toxicity.WAIT
            elif k != "be" or not left:
                left, named = max(0, left - 1), max(0, named - 1)
        return left > 0

    def threatened(i):
        """Whether the word is the victim of a threat before it, or a threat to a victim before it."""
        near = range(i - 1, max(-1, i - 1 - toxicity.STRIKE), -1)
        k = next((j for j in near if kinds[j] in ("threat", "will", "you", "they")), None)
        if k is None:
            return False
        if kinds[i] == "threat":
            if kinds[k] != "you":
                return False
            before = range(k - 1, max(-1, k - 1 - toxicity.STRIKE), -1)
            w = next((j for j in before if kinds[j] in ("threat", "will", "you", "they")), None)
            return w is not None and kinds[w] == "will"
        return kinds[k] == "threat" and not spent(k) and (kinds[i] == "you" or kinds[i] == "they" and announced(k))

    def spent(k):
        return threatened(k)

    def announced(k):
        near = range(k - 1, max(-1, k - 1 - toxicity.STRIKE), -1)
        j = next((j for j in near if kinds[j] in ("threat", "will", "you", "they")), None)
        return j is not None and (kinds[j] == "will" or kinds[j] == "threat" and not spent(j) and announced(j))

    for i, k in enumerate(kinds):
        soft = "report" in kinds[:i] or "negation" in kinds[max(0, i - toxicity.DENIAL) : i]
        if k == "insult":
            last, used = words[i], i
            out.append(("soft" if soft else "aimed" if meant(i) else "plain", last))
        elif k in ("you", "they", "threat") and threatened(i) and not soft:
            out.append(("threat", words[i]))
        elif k == "you" and used >= 0 and i - used <= toxicity.CALL and "you" not in kinds[used:i] and not soft:
            out.append(("aimed", last))
    return out


def test_the_composed_machine_reads_clauses_as_a_plain_reader_does():
    model, rng = toxicity.Model().ready(), random.Random(8)
    words = ["idiot", "clown", "kill", "burn", "you", "your", "they", "him", "is", "are", "will", "going", "not", "never", "said", "a", "the", "walk", "lights"]
    for _ in range(20_000):
        clause = " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        assert model.matches(clause) == plain_matches(model, clause), clause


def test_toxic_clauses():
    model = toxicity.Model().ready()
    path = lambda clause: [p for p, _ in model.matches(clause)]
    assert path("you idiot") == path("you are such an idiot") == path("he is an idiot") == ["aimed"]
    assert path("idiot you") == ["plain", "aimed"]
    assert path("an idiot came") == path("he met a clown") == ["plain"]
    assert path("he is not an idiot") == path("she said he was an idiot") == path("they claimed he was not an idiot") == ["soft"]
    assert path("i will kill you") == path("i am going to kill them") == path("ich werde dich töten") == path("kill you") == ["threat"]
    assert path("i will not kill you") == path("he said he will kill you") == path("kill the lights") == path("they beat him") == path("nice day") == []
    assert model.clauses("A day. You Idiot!\nFine; clown") == [" you idiot", " clown"]
    toxic = ["You are an idiot.", "I will kill you.", "You ugly cow", "He is a liar and a worthless idiot", "You are a stupid idiot. Loser!", "pathetic loser", "Ich werde dich töten!", "Tu es un idiota"]
    clean = ["", "nice words", "A clown performed.", "The garbage truck came.", "He is not an idiot.", "She said he was an idiot.", "They claimed he was not an idiot", "I will not kill you.", "Kill the lights, then burn the letters.", "They beat him by two goals.", "He never called you a clown"]
    assert [t for t in toxic if model.score(t) < 0.5] == [] and [t for t in clean if model.score(t) >= 0.5] == []
    assert model.score("") == model.score("nice words") < model.score("A clown performed.") < 0.5


def test_toxicity_learns_words_and_keeps_folds_apart(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(400):
        bad = i % 8 == 0
        words = [word() for _ in range(40)]
        if bad:
            words[5] = "zzgrub" + word()[:3]
            words[20] = "zzgrub" + word()[:3]
        rows.append((i, " ".join(words), bad))
    docs = spark.createDataFrame([(i, t, "en", "s", None, "k", 0) for i, t, _ in rows] + [(500, None, "en", "s", None, "k", 0)], DOCS)
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_model(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score_texts(docs, model).collect()}
    assert len(out) == 401
    for i, _, bad in rows:
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        if out[i]["held_out"]:
            assert out[i]["predicted"] == int(bad)
    assert 0 <= out[500]["score"] < 0.5
    empty = toxicity.fit_model(docs, labels.limit(0))
    assert empty == toxicity.Model()
    assert toxicity.score_texts(docs.limit(0), empty).count() == 0
    assert toxicity.without_toxic(docs, model).where(F.col("doc_id") == 500).count() == 1
